"""Reading of tables and the folder that all executors share."""

from lexatlas.sources.shared import Workspace, hint_small, join_hot, shared_folder
from lexatlas.sources.tables import table

__all__ = ["Workspace", "hint_small", "join_hot", "shared_folder", "table"]
