"""Logging of the library by Python's own logging: human or JSON lines, to the console or a rotated file."""

from __future__ import annotations

import json
import logging
import os
import sys
import threading
from dataclasses import dataclass
from logging.handlers import RotatingFileHandler, TimedRotatingFileHandler

_LOGGER = logging.getLogger("orrery")
_LOGGER.addHandler(logging.NullHandler())
_LOCK = threading.Lock()
_state = {"ready": False}

#: Names of levels, names of formats.
LEVELS = {"TRACE": "DEBUG", "DEBUG": "DEBUG", "INFO": "INFO", "WARN": "WARNING", "WARNING": "WARNING", "ERR": "ERROR", "ERROR": "ERROR", "FATAL": "CRITICAL", "CRITICAL": "CRITICAL"}
FORMATS = ("human", "json")


@dataclass(frozen=True)
class Defaults:
    level: str
    format: str


#: What each kind of environment logs if nothing is said.
DEFAULTS = {"production": Defaults("ERROR", "json"), "development": Defaults("WARNING", "human"), "testing": Defaults("CRITICAL", "human"), "jupyter": Defaults("INFO", "human"), "ci": Defaults("WARNING", "human")}
#: What ENVIRONMENT may say, and the variables that tell an environment otherwise.
SAID = {"prod": "production", "production": "production", "dev": "development", "development": "development", "test": "testing", "testing": "testing"}
SIGNS = {"testing": ("PYTEST_CURRENT_TEST",), "jupyter": ("JUPYTER_SERVER_ROOT", "JPY_PARENT_PID"), "ci": ("CI", "GITHUB_ACTIONS", "GITLAB_CI"), "production": ("KUBERNETES_SERVICE_HOST", "DOCKER_CONTAINER")}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record), "level": record.levelname, "target": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line)


def environment() -> str:
    """production, development, testing, jupyter or ci: as ENVIRONMENT says, else as variables and loaded modules show."""
    if kind := SAID.get(os.environ.get("ENVIRONMENT", "").strip().lower()):
        return kind
    for kind, names in SIGNS.items():
        if any(os.environ.get(n) for n in names):
            return kind
    return "testing" if "pytest" in sys.modules else "jupyter" if "IPython" in sys.modules else "development"


def _choice(given: str | None, variable: str, allowed: dict[str, str], default: str) -> str:
    """The argument, which must be allowed, else the variable, else the default; a variable that is not allowed is warned of."""
    if given is not None:
        if given.strip().upper() not in allowed:
            raise ValueError(f"{given!r} is none of {', '.join(sorted(allowed))}")
        return allowed[given.strip().upper()]
    said = os.environ.get(variable, "").strip().upper()
    if said and said not in allowed:
        print(f"{variable}={said} is none of {', '.join(sorted(allowed))}; {default} is used", file=sys.stderr)
    return allowed.get(said, default)


def _start(handler: logging.Handler, level: str | None, style: str | None) -> None:
    usual = DEFAULTS[environment()]
    styled = _choice(style, "ORRERY_LOG_FORMAT", {f.upper(): f for f in FORMATS}, usual.format)
    _LOGGER.setLevel(_choice(level, "ORRERY_LOG_LEVEL", LEVELS, usual.level))
    handler.setFormatter(JsonLines() if styled == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    _LOGGER.addHandler(handler)
    _state["ready"] = True


def init_logging(level: str | None = None, format: str | None = None) -> bool:
    """Log to the console; False if logging was set up before. Level and format come from ORRERY_LOG_LEVEL and ORRERY_LOG_FORMAT or the environment."""
    with _LOCK:
        if _state["ready"]:
            return False
        _start(logging.StreamHandler(), level, format)
        return True


def init_file_logging(directory: str, prefix: str = "orrery", level: str | None = None, format: str | None = None, keep: int = 14, max_bytes: int | None = None) -> bool:
    """Log to a file in a folder; False if logging was set up before.

    A new file begins each day, or with ``max_bytes`` whenever one is so long; the ``keep`` last old ones stay.
    """
    with _LOCK:
        if _state["ready"]:
            return False
        os.makedirs(directory, exist_ok=True)
        path = os.path.join(directory, f"{prefix}.log")
        _start(RotatingFileHandler(path, maxBytes=max_bytes, backupCount=keep) if max_bytes else TimedRotatingFileHandler(path, when="midnight", backupCount=keep), level, format)
        return True


def is_logging_initialized() -> bool:
    return _state["ready"]
