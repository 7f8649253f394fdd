"""Log set-up of the command line: INFO to the console, everything to a file that rolls over."""

from __future__ import annotations

import logging
import time
from datetime import datetime
from logging.handlers import RotatingFileHandler
from pathlib import Path

NAME = "palimpsest"
#: Size at which the file rolls over, and for how long files are kept.
FILE_BYTES, KEEP_DAYS = 10 << 20, 7
BACKUPS = 20


def setup_logging(directory: str | Path, name: str = NAME) -> Path:
    """Log of the package ``name`` on the driver; gives the path of the new file. Older files of the folder go."""
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    for old in folder.glob(f"{name}_*.log*"):
        if old.stat().st_mtime < time.time() - KEEP_DAYS * 86400:
            old.unlink()
    path = folder / f"{name}_{datetime.now():%Y%m%d_%H%M%S}.log"
    log = logging.getLogger(name)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    form = logging.Formatter("%(asctime)s | %(levelname)-8s | %(message)s", "%Y-%m-%d %H:%M:%S")
    for handler, level in ((logging.StreamHandler(), logging.INFO), (RotatingFileHandler(path, maxBytes=FILE_BYTES, backupCount=BACKUPS), logging.DEBUG)):
        handler.setLevel(level)
        handler.setFormatter(form)
        log.addHandler(handler)
    log.setLevel(logging.DEBUG)
    log.propagate = False
    return path


def get_logger(module: str | None = None) -> logging.Logger:
    return logging.getLogger(f"{NAME}.{module}" if module else NAME)
