"""Where intermediate results are written: the library's own scratch tables, under the names used here."""

from tallyloom.sinks.scratch import shared_dir, shared_path, tidy, written

__all__ = ["shared_dir", "shared_path", "tidy", "written"]
