"""Service contracts (OpenAPI documents) compiled on the driver to routes, event mappings and secret locations."""

from .document import Contract, ContractError, EventMapping, Operation, load

__all__ = ["Contract", "ContractError", "EventMapping", "Operation", "load"]
