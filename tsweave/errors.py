"""Errors that say which rule an input breaks."""


class TsweaveError(Exception):
    """Base of the library's errors."""


class ConfigurationError(TsweaveError):
    """A parameter is out of its range."""


class InvalidFormulaError(TsweaveError):
    """A formula can't be parsed or evaluated."""


class InsufficientDataError(TsweaveError):
    """There are too few observations."""


class DataQualityError(TsweaveError):
    """An input breaks its contract."""


class SymbolNotFoundError(TsweaveError):
    """A symbol isn't in the catalog."""


class CollectionError(TsweaveError):
    """Some of several sources couldn't be collected."""
