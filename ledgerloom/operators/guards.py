"""Checks on the driver before a plan is built: payload shapes, arguments, values that can't be names."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Mapping

#: What a field's name looks like, and how deep a payload may be.
FIELD_NAME = re.compile(r"[a-z_][a-z0-9_]*")
MAX_DEPTH = 10
#: Shapes of document references, which never stand for a name.
REFERENCES = re.compile(r"^(S\d{4,6}|P\d{4,6}|WH/(IN|OUT|INT)/\d+|INV/\d{4}/\d+)$")


def check_payload(payload) -> None:
    """Refuse a payload by the first place that is too deep or has a key that no field can have; values are free.

    Places wait on a stack with their paths. For payloads in a table see functions.variant.payload_verdicts.
    """
    places = [((), payload)]
    while places:
        path, value = places.pop()
        if len(path) > MAX_DEPTH:
            raise ValueError(f"nested too deep at {path}")
        named = isinstance(value, Mapping)
        steps = value.items() if named else enumerate(value) if isinstance(value, (list, tuple)) else ()
        for step, inner in steps:
            if named and (not isinstance(step, str) or FIELD_NAME.fullmatch(step) is None):
                raise ValueError(f"bad key {step!r} at {path}")
            places.append(((*path, step), inner))


def check_arguments(fn: Callable, args: Mapping) -> None:
    """Every argument is one that the function names."""
    unknown = set(args) - set(inspect.signature(fn).parameters)
    if unknown:
        raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")


def check_name(value: str) -> str:
    """A name parameter that looks like a document reference is a mix-up."""
    if REFERENCES.match(value):
        raise ValueError(f"{value!r} is a reference, not a name")
    return value
