"""Errors of the engine: it fails loudly and never repairs data silently."""


class MissingRawDataError(FileNotFoundError):
    """A raw table isn't there."""


class SchemaError(ValueError):
    """A table lacks a required column."""


class DataIntegrityError(ValueError):
    """Rows are ambiguous: duplicate keys, conflicting labels, leaking splits."""


class SplitError(ValueError):
    """A split is impossible or not pure."""


class SemanticJoinError(ValueError):
    """Similarities don't match the rows they are for."""


class RankingGroupError(ValueError):
    """Rows can't be grouped for learning to rank."""


class RankerEvalError(ValueError):
    """Rankers were evaluated on different candidates or queries."""


class SemanticDiagnosticError(ValueError):
    """Diagnostics of different query sets."""


#: What a contract raises.
ERRORS = (MissingRawDataError, SchemaError, DataIntegrityError, SplitError, SemanticJoinError, RankingGroupError, RankerEvalError, SemanticDiagnosticError)
