"""Seeds that depend on a name only."""

from __future__ import annotations

import hashlib


def stable_seed(name: str, modulus: int = 1 << 31) -> int:
    """The first eight bytes of the name's SHA-1, as a number, modulo modulus."""
    return int.from_bytes(hashlib.sha1(name.encode()).digest()[:8], "big") % modulus
