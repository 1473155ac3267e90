"""Reading the input tables and materialising intermediate ones."""

from funnelworks.sources.profile import table_profile
from funnelworks.sources.readers import REJECTED, Tables, read_table, read_tables
from funnelworks.sources.storage import checkpoint_root, materialise

__all__ = ["REJECTED", "Tables", "checkpoint_root", "materialise", "read_table", "read_tables", "table_profile"]
