"""Table backups as Spark jobs: snapshots, catalog, chains, retention, segments, inventory, alerts, schedules."""

from keelson.session import build_session, materialise, scratch_path

__all__ = ["build_session", "materialise", "scratch_path"]
