"""Errors that the library raises, each with a stable code."""


class MillraceError(Exception):
    code = "E000"


class ProfileError(MillraceError):
    code = "E100"


class UnknownAsset(ProfileError):
    code = "E101"


class InheritanceTooDeep(ProfileError):
    code = "E102"


class DuplicateColumn(ProfileError):
    code = "E103"


class SourceError(MillraceError):
    code = "E200"


class MissingSource(SourceError, FileNotFoundError):
    code = "E201"


class UnreadableSource(SourceError, ValueError):
    code = "E202"


class TextError(MillraceError):
    code = "E300"


class BadChunking(TextError, ValueError):
    code = "E301"


class MissingTemplate(TextError, FileNotFoundError):
    code = "E302"


class ExpressionError(MillraceError):
    code = "E400"


class PlanError(MillraceError):
    code = "E500"


class UnknownOperation(PlanError, ValueError):
    code = "E501"


class PermissionDenied(PlanError, PermissionError):
    code = "E502"


class StepFailed(PlanError):
    code = "E503"
