"""Errors with a code."""

from __future__ import annotations

from enum import Enum


class Code(Enum):
    """What went wrong; the names are fixed values."""

    Ok = "Ok"
    InvalidArgument = "InvalidArgument"
    OutOfMemory = "OutOfMemory"
    NotSupported = "NotSupported"
    NotFound = "NotFound"
    AlreadyExists = "AlreadyExists"
    Overflow = "Overflow"
    Corruption = "Corruption"
    IoError = "IoError"
    IoTimeout = "IoTimeout"
    IoAlignment = "IoAlignment"
    PageNotFound = "PageNotFound"
    BufferPoolFull = "BufferPoolFull"
    InvalidPageId = "InvalidPageId"
    TypeNotFound = "TypeNotFound"
    TypeAlreadyRegistered = "TypeAlreadyRegistered"
    CatalogCorrupted = "CatalogCorrupted"
    ParseError = "ParseError"
    AnalyzerError = "AnalyzerError"
    ExecutorError = "ExecutorError"


class EngineError(Exception):
    def __init__(self, code: Code, message: str = ""):
        super().__init__(f"{code.value}: {message}" if message else code.value)
        self.code, self.message = code, message

