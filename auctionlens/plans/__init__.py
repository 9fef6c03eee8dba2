from auctionlens.plans.joins import bounded_broadcast, join_dimension  # noqa: F401
from auctionlens.plans.session import ensure_checkpoint_dir, get_session  # noqa: F401
