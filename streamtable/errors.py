"""Errors of the engine."""


class StreamtableError(Exception):
    """Any error of this library."""


class TableExists(StreamtableError):
    pass


class TableNotFound(StreamtableError):
    pass


class SchemaExists(StreamtableError):
    pass


class SchemaNotFound(StreamtableError):
    pass


class SchemaNotEmpty(StreamtableError):
    pass


class CatalogExists(StreamtableError):
    pass


class CatalogNotFound(StreamtableError):
    pass


class TableKindError(StreamtableError):
    """The operation doesn't apply to this kind of table."""


class InvalidIndex(StreamtableError):
    pass


class DataTypeError(StreamtableError):
    pass


class ShapeError(StreamtableError):
    """Shapes that can't be broadcast, joined or indexed."""


class ConcurrentChange(StreamtableError):
    """Another process has changed the datastore meanwhile."""
