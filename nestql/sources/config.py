"""Configuration: a small YAML subset of scalar keys and one list of datasets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_COMMENT = re.compile(r"(?:^|\s)#(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$).*$")


@dataclass
class DatasetEntry:
    name: str = ""
    file: str = ""
    xsd_file: str = ""


@dataclass
class Config:
    port: str = "8888"
    static_dir: str = "static"
    enable_samples: bool = True
    log_requests: bool = False
    datasets: list[DatasetEntry] = field(default_factory=list)


def _pair(text: str) -> tuple[str, str]:
    key, _, value = text.partition(":")
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return key.strip(), value


def parse_config(text: str) -> Config:
    """Unknown keys are ignored and missing ones keep their defaults; a dataset without a name is left out."""
    config, entries, inside = Config(), [], False
    for raw in text.splitlines():
        line = _COMMENT.sub("", raw).rstrip()
        if not line.strip():
            continue
        body = line.strip()
        if not line[0].isspace() and not body.startswith("- "):
            key, value = _pair(body)
            inside = key == "datasets"
            if key in ("port", "static_dir"):
                setattr(config, key, value)
            elif key in ("enable_samples", "log_requests"):
                setattr(config, key, value.lower() in ("true", "yes", "1", "on"))
        elif inside:
            if body.startswith("- "):
                entries.append(DatasetEntry())
                body = body[2:].strip()
            elif not entries:
                entries.append(DatasetEntry())
            key, value = _pair(body)
            if key in ("name", "file", "xsd_file"):
                setattr(entries[-1], key, value)
    config.datasets = [e for e in entries if e.name]
    return config


def load_config(path: str) -> Config:
    """A missing file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse_config(f.read())
    except FileNotFoundError:
        return Config()
