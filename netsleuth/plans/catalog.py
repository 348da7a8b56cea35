"""Imports every query module so that the registry is complete."""

from netsleuth.plans import q_features  # noqa: F401
from netsleuth.plans import q_ingest  # noqa: F401
from netsleuth.plans import q_model  # noqa: F401
from netsleuth.plans import q_rules  # noqa: F401
from netsleuth.plans import q_tables  # noqa: F401
from netsleuth.plans import q_detect  # noqa: F401
from netsleuth.plans import q_stream  # noqa: F401
from netsleuth.plans import q_job  # noqa: F401
from netsleuth.plans import q_store  # noqa: F401
