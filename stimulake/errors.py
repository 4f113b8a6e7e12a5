"""Errors that are raised before a plan runs."""


class EngineError(Exception):
    """Base of all."""


class ModelNotFoundError(EngineError):
    """No model has that id."""


class ModelLoadError(EngineError):
    """A model's files can't be used."""


class InvalidParameterError(EngineError):
    """A selection or an argument isn't allowed."""


class StimulusError(EngineError):
    """Stimuli haven't the form a model needs."""


class ResourceError(EngineError):
    """A resource isn't there."""
