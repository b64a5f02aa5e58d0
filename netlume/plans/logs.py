"""Where a run's messages go: the terminal, the system's log, a file, or nowhere."""

from __future__ import annotations

import logging
import logging.handlers
import os
import sys

MODES = ("terminal", "syslog", "file", "disabled")


def logger(mode: str = "terminal", name: str = "netlume", path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The logger of a run, on the driver.  What cannot be written to its place goes to the terminal."""
    if mode not in MODES:
        raise ValueError(f"no such way of logging: {mode!r}")
    own = logging.getLogger(name)
    for handler in [*own.handlers]:
        own.removeHandler(handler)
        handler.close()
    own.propagate, terminal = False, logging.StreamHandler(sys.stderr)
    if mode == "disabled":
        handler = logging.NullHandler()
    elif mode == "file" and path:
        handler = logging.FileHandler(path)
    elif mode == "syslog" and os.path.exists("/dev/log"):
        handler = logging.handlers.SysLogHandler("/dev/log")
    else:
        handler = terminal
    handler.setFormatter(logging.Formatter("[%(asctime)s] %(name)s: %(message)s"))
    own.addHandler(handler)
    own.setLevel(level)
    return own
