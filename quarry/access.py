"""Who may call: origin, host and bearer checks as a pure function."""

from __future__ import annotations

import hmac
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

OPEN_PATHS = frozenset({"/health"})


@dataclass(frozen=True)
class Refusal:
    status: int
    message: str
    headers: tuple[tuple[str, str], ...] = ()


def allowed(value: str, patterns: Sequence[str]) -> bool:
    """``value`` is listed, or ``host:*`` is and only the port differs."""
    return any(value == p or (p.endswith(":*") and value.startswith(p[:-1])) for p in patterns)


def refuse(path: str, headers: Mapping[str, str], token: str = "", origins: Sequence[str] = (), hosts: Sequence[str] = ()) -> Refusal | None:
    """Why a request is refused, None if it isn't.  Header names are in lower case.

    A request that names an origin needs it listed; hosts are checked if any is listed; a token, if one is set, is needed everywhere
    but for the health check.
    """
    origin, host = headers.get("origin", ""), headers.get("host", "")
    if origin and not allowed(origin, origins):
        return Refusal(403, "Origin not allowed")
    if hosts and not allowed(host, hosts):
        return Refusal(421, "Host not allowed")
    if token and path not in OPEN_PATHS:
        scheme, _, given = headers.get("authorization", "").partition(" ")
        if scheme.lower() != "bearer" or not hmac.compare_digest(given.strip().encode(), token.encode()):
            return Refusal(401, "Unauthorized", (("WWW-Authenticate", "Bearer"),))
    return None
