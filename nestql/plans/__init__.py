"""Planning: a request and a schema become one DataFrame."""
