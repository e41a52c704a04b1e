"""What the operators here take from the library: cutting lineage in the shared folder, broadcasting what is measured to be small, joins on hot keys."""

from ..plans.lineage import SENT_BYTES, cut, sent, shared_folder, small, spread

__all__ = ["SENT_BYTES", "cut", "sent", "shared_folder", "small", "spread"]
