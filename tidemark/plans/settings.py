"""What a driver keeps beside its data: settings, the release id of a grid directory, a log of its runs."""

from __future__ import annotations

import configparser
import logging
import sys
from datetime import datetime
from pathlib import Path

SECTION = "Default"
RELEASE_FILE = "grids_version.txt"


def read_settings(path: str) -> dict[str, str]:
    """All sections together, of repeated keys the last; no file is no settings. grids_path is always there."""
    parser = configparser.ConfigParser()
    parser.read(path)
    return {"grids_path": ""} | {k: v for name in parser.sections() for k, v in parser[name].items()}


def write_setting(path: str, key: str, value: str | None) -> dict[str, str]:
    """Sets a key, or with None removes it; the settings after that."""
    settings = read_settings(path)
    settings[key.lower()] = value or ""
    if value is None:
        settings.pop(key.lower())
    parser = configparser.ConfigParser()
    parser[SECTION] = settings
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        parser.write(f)
    return read_settings(path)


def save_release(directory: str, release: str) -> str:
    """Writes the release id where sources.files.release() finds it."""
    path = Path(directory) / RELEASE_FILE
    path.write_text(release)
    return str(path)


def release_date(release: str) -> str | None:
    """yyyy-mm-dd of the eight digits that a release id ends with; None where they are no date."""
    try:
        return datetime.strptime(release[-8:], "%Y%m%d").date().isoformat()
    except ValueError:
        return None


def run_log(name: str | None = None, path: str | None = None) -> logging.Logger:
    """A logger with information on stdout, warnings and errors on stderr, and all with time and level in a file if given."""
    log = logging.getLogger(name or f"tidemark_{datetime.now():%Y%m%d_%H%M%S}")
    log.setLevel(logging.INFO)
    log.propagate = False
    if log.handlers:
        return log
    calm, alarmed = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    calm.addFilter(lambda r: r.levelno < logging.WARNING)
    alarmed.setLevel(logging.WARNING)
    sinks = [calm, alarmed]
    if path:
        sinks.append(logging.FileHandler(path))
        sinks[-1].setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
    for s in sinks:
        log.addHandler(s)
    return log


def fail(log: logging.Logger, message: str, kind: type[Exception] = ValueError) -> None:
    """Logs an error and raises it."""
    log.error(message)
    raise kind(message)
