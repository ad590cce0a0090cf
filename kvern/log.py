"""Log lines with a severity, the component that speaks, a time, and the table that it is about."""

from __future__ import annotations

import logging
import sys

TRACE = 5
LEVELS = {"trace": TRACE, "debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL}
FORMAT = "(%(component)s) (%(levelname)s) (%(asctime)s.%(msecs)03d) (%(table)s): %(message)s"


class _Named(logging.LoggerAdapter):
    """A logger that speaks for a component, about a table if it has one."""

    def about(self, table: str) -> _Named:
        return _Named(self.logger, {**self.extra, "table": table})

    def trace(self, message: str, *args) -> None:
        self.log(TRACE, message, *args)


def configure(level: str) -> None:
    """Sends the lines of that severity and above to the error stream; called again, it changes the severity."""
    logging.addLevelName(TRACE, "TRACE")
    root = logging.getLogger("kvern")
    root.setLevel(LEVELS[level])
    if not root.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter(FORMAT, "%H:%M:%S", defaults={"component": "kvern", "table": "-"}))
        root.addHandler(handler)


def get_logger(component: str) -> _Named:
    return _Named(logging.getLogger("kvern"), {"component": component, "table": "-"})
