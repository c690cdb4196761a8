"""Queries over the driver's tables; importing the package registers them all."""

from subtide.plans import records, registry, services, stateful  # noqa: F401
