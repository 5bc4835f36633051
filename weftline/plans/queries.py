"""All queries of the library but those of the training-data subpackage."""

from weftline.plans import fixtures, pages, tables  # noqa: F401  (they register)
from weftline.plans.registry import ORACLES, QUERIES

FLAGSHIP = "page_profile"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
