"""tastegrid: recommendation analytics as Spark jobs over whole rating, catalogue and event tables."""

from tastegrid.config import Params
from tastegrid.session import build_session

__all__ = ["Params", "build_session"]
