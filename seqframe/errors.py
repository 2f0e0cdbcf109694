"""Exceptions of the library. Each is also the builtin exception that a caller would expect."""


class SeqError(Exception):
    """Base of all errors raised by seqframe."""


class SeqTypeError(SeqError, TypeError):
    """A sequence or argument of the wrong kind."""


class SeqValueError(SeqError, ValueError):
    """An argument outside its range."""


class TranslationError(SeqError, ValueError):
    """A sequence that cannot be translated."""


class AlignmentError(SeqError, ValueError):
    """Sequences or options that cannot be aligned."""


class SeqIOError(SeqError, OSError):
    """A file that cannot be read or written."""


class EngineError(SeqError, RuntimeError):
    """A failure inside a vectorised kernel."""
