"""All registered queries; importing the modules registers them."""
from faultline.catalog.registry import QUERIES
# later modules use the SQL views of earlier ones
from faultline.catalog import scoring  # noqa: F401  isort:skip
from faultline.catalog import history  # noqa: F401  isort:skip
from faultline.catalog import graph  # noqa: F401  isort:skip
from faultline.catalog import readings  # noqa: F401  isort:skip
from faultline.catalog import exposure  # noqa: F401  isort:skip
from faultline.catalog import increments  # noqa: F401  isort:skip
from faultline.catalog import shocks  # noqa: F401  isort:skip
from faultline.catalog import basics  # noqa: F401  isort:skip
from faultline.catalog import relations  # noqa: F401  isort:skip
from faultline.catalog import studies  # noqa: F401  isort:skip
from faultline.catalog import quality  # noqa: F401  isort:skip
from faultline.catalog import capacity  # noqa: F401  isort:skip
from faultline.catalog import printed  # noqa: F401  isort:skip
from faultline.catalog import clauses  # noqa: F401  isort:skip
from faultline.catalog import textjobs  # noqa: F401  isort:skip
from faultline.catalog import wording  # noqa: F401  isort:skip
from faultline.catalog import streams  # noqa: F401  isort:skip

__all__ = ["QUERIES"]
