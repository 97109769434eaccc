"""Import every plan module so that all queries are registered."""

from helixframe.plans import select_queries  # noqa: F401
from helixframe.plans import token_queries  # noqa: F401
from helixframe.plans import feature_queries  # noqa: F401
from helixframe.plans import metric_queries  # noqa: F401
from helixframe.plans import fold_queries  # noqa: F401
from helixframe.plans import region_queries  # noqa: F401
from helixframe.plans import text_queries  # noqa: F401
from helixframe.plans import model_queries  # noqa: F401
from helixframe.plans import io_queries  # noqa: F401
from helixframe.plans import stream_queries  # noqa: F401
