"""Errors of tables and their settings."""


class TableError(Exception):
    """Base of the errors below."""


class ConfigError(TableError):
    pass


class TableExists(TableError):
    pass


class TableNotFound(TableError):
    pass


class InvalidSchema(TableError):
    pass


class PrimaryKeyTypeMismatch(TableError):
    pass


class ColumnCountMismatch(TableError):
    pass


class ColumnTypeMismatch(TableError):
    pass


class NullValue(TableError):
    pass


class VersionConflict(TableError):
    pass
