from auctionlens.sources.fixtures import FIXTURE_HINGE, fixture_tables  # noqa: F401
from auctionlens.sources.schema import AdTables  # noqa: F401
