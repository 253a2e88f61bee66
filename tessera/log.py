"""Logging to stderr; the level comes from TESSERA_LOG (debug, info, warning, error; default warning)."""

from __future__ import annotations

import logging
import os

log = logging.getLogger("tessera")
if not log.handlers:
    _out = logging.StreamHandler()
    _out.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    log.addHandler(_out)
    log.setLevel(os.environ.get("TESSERA_LOG", "warning").upper())
    log.propagate = False
