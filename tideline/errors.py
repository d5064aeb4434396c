"""One exception hierarchy for the library."""


class TidelineError(ValueError):
    """Base of all errors raised for wrong input."""


class InvalidDuration(TidelineError):
    """A duration is not <digits><unit>, is zero, or overflows 64 bits."""


class InvalidInterval(TidelineError):
    """A bucket or chunk width is not positive."""


class InvalidIdentifier(TidelineError):
    """A table or column name is not [A-Za-z_][A-Za-z0-9_]*."""


class UnknownAggregate(TidelineError):
    """An aggregate's name is not known."""


class InvalidPayload(TidelineError):
    """A segment payload has the wrong magic, version, length or checksum."""


class InvalidPoint(TidelineError):
    """A point has no measurement, no field, an empty key, or a value that is not finite."""


class MissingHypertable(TidelineError):
    """A hypertable, rollup or policy is not in the catalog."""
