"""Where jobs keep written tables: the folder that the session names in spark.checkpoint.dir."""

from voxelframe.shared import checkpointed, new_path, written

__all__ = ["checkpointed", "new_path", "written"]
