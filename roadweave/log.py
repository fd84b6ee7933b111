"""The package's logger: silent until set up."""

from __future__ import annotations

import logging
import sys
from datetime import datetime
from pathlib import Path

NAME = "roadweave"
FORMAT = "%(asctime)s | %(levelname)-7s | %(name)s | %(message)s"


def get_logger(name: str | None = None) -> logging.Logger:
    return logging.getLogger(NAME if not name else name if name.split(".")[0] == NAME else f"{NAME}.{name}")


def setup_logging(logfile: str | None = None, level: int = logging.INFO, console: bool = True, log_dir: str = "logs") -> tuple[logging.Logger, str]:
    """Sends the driver's messages to a file, one named by the time unless given, and to the console; again replaces what was set up."""
    path = Path(logfile) if logfile else Path(log_dir) / f"{NAME}_{datetime.now():%Y%m%d_%H%M%S}.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    logger = get_logger()
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    for handler in [logging.FileHandler(path), *([logging.StreamHandler(sys.stdout)] if console else [])]:
        handler.setFormatter(logging.Formatter(FORMAT))
        logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger, str(path)
