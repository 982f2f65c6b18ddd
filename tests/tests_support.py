"""Log records shared by tests."""

from __future__ import annotations

from datetime import datetime, timezone


def iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def rollout_records(seed: int) -> list[dict]:
    """A file with two interleaved counter streams, repeats and calls."""
    at, main, side, out = 1_710_000_000_000, 0, 10_000, []
    out.append({"timestamp": iso(at), "type": "session_meta", "payload": {"cwd": f"/w/p{seed}"}})
    for i in range(8):
        at += 5000
        used = 10 + i + seed
        if i % 3 == 2:
            side += used
            total = side
        else:
            main += used
            total = main
        info = {"total_token_usage": {"input_tokens": total}, "last_token_usage": {"input_tokens": used}}
        notice = {"timestamp": iso(at), "type": "event_msg", "payload": {"type": "token_count", "info": info}}
        out.append(notice)
        if i % 4 == 1:
            out.append(notice)
        if i % 2:
            call = {"type": "function_call", "name": "grep", "call_id": f"c{i}"}
            out.append({"timestamp": iso(at + 1000), "type": "response_item", "payload": call})
    return out
