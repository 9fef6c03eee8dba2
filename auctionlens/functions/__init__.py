from auctionlens.functions.exprs import (  # noqa: F401
    ERA_POST,
    ERA_PRE,
    any_of,
    case_label,
    count_if,
    dround,
    era,
    is_true,
    money,
    os_major,
    ratio,
    ts_lit,
    version_rate,
)
