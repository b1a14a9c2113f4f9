"""Errors with the exit code that the command line gives them."""


class LoomError(Exception):
    exit_code = 1


class ConfigError(LoomError):
    exit_code = 2


class SourceError(LoomError):
    exit_code = 2


class BackendError(LoomError):
    exit_code = 3


class StaleError(BackendError):
    exit_code = 4
