"""All registered queries of the lakehouse; importing the modules registers them."""

from brackwater.plans import catalog, governance, live  # noqa: F401
from brackwater.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
