from auctionlens.streaming.guardrail import (  # noqa: F401
    enrich_with_requests,
    guardrail_events,
    join_request_stream,
    replay_guardrail,
    start_guardrail_stream,
)
