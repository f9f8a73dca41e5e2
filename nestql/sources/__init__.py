"""Sources: JSON, XML with XSD hints, configuration files, the built-in sample, nested views of flat tables."""
