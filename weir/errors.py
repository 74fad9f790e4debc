"""Exceptions of the engine."""


class FlowError(Exception):
    """Base of all errors raised by a flow."""


class EmptyFlowError(FlowError):
    """A flow without children was run."""


class SiblingFailedError(FlowError):
    """A child was stopped because another child of the same flow failed."""


class SiblingCancelledError(FlowError):
    """A child was stopped because another child of the same flow was cancelled."""


class UpstreamFailedError(FlowError):
    """A child did not run because one that it depends on failed."""


class UpstreamCancelledError(FlowError):
    """A child did not run because one that it depends on was cancelled."""


class FlowCancelledError(FlowError):
    """A flow was cancelled from outside."""


class RejectedRowError(FlowError):
    """Rows were offered to a target that takes none."""


class RoutingError(FlowError, ValueError):
    """A routing table is frozen, or leaves rows without a target."""


class MappingError(FlowError, ValueError):
    """A column mapping does not fit the source or the table."""

    def __init__(self, what: str, mapping: object = None, path: str | None = None):
        super().__init__(what + (f"; mapping {mapping}" if mapping is not None else "") + (f"; at {path}" if path else ""))
        self.mapping, self.path = mapping, path


def root_cause(error: BaseException) -> BaseException:
    """The original error below propagated ones: an own failure beats those that only report another's."""
    if isinstance(error, BaseExceptionGroup):
        own = [e for e in map(root_cause, error.exceptions) if not isinstance(e, (SiblingFailedError, SiblingCancelledError, UpstreamFailedError, UpstreamCancelledError))]
        return own[0] if own else root_cause(error.exceptions[0])
    seen = set()
    while isinstance(error, FlowError) and error.__cause__ is not None and id(error) not in seen:
        seen.add(id(error))
        error = error.__cause__
    return error
