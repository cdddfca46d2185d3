"""Errors of the engine. Those about bad input are ValueErrors as well."""


class LakeError(Exception):
    pass


class CatalogError(LakeError):
    pass


class TableNotFound(CatalogError):
    pass


class SchemaError(LakeError, ValueError):
    pass


class ValidationError(LakeError, ValueError):
    pass


class MaintenanceError(LakeError, ValueError):
    pass


class CompactionError(MaintenanceError):
    pass


class Unsupported(LakeError, NotImplementedError):
    pass


class CommitConflict(LakeError):
    pass
