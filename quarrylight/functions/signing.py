"""Signed and sealed references, on the driver: no secret is ever part of a plan."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os


class Signer:
    """HMAC-SHA256 over fields with their lengths, so that no two lists of fields sign alike."""

    def __init__(self, key: bytes, ttl: int = 300):
        if not key:
            raise ValueError("an empty key signs nothing")
        self.key, self.ttl = key, ttl

    def _mac(self, purpose: str, *fields: bytes) -> bytes:
        message = b"".join(len(f).to_bytes(8, "big") + f for f in (purpose.encode(), *fields))
        return hmac.new(self.key, message, hashlib.sha256).digest()

    def sign(self, citation: str, media_type: str, now: int) -> tuple[int, str]:
        """When it expires, and the signature."""
        until = now + self.ttl
        return until, self._mac("reference", citation.encode(), media_type.encode(), str(until).encode()).hex()

    def verify(self, citation: str, media_type: str, until: int, signature: str, now: int) -> bool:
        want = self._mac("reference", citation.encode(), media_type.encode(), str(until).encode()).hex()
        return now < until and hmac.compare_digest(want.encode(), signature.encode())

    def _stream(self, nonce: bytes, n: int) -> bytes:
        blocks = (self._mac("stream", nonce, k.to_bytes(8, "big")) for k in range(-(-n // 32)))
        return b"".join(blocks)[:n]

    def seal(self, value: dict, nonce: bytes | None = None) -> str:
        """A value that only the key opens, and that nobody can change: encrypted, then authenticated."""
        nonce = os.urandom(16) if nonce is None else nonce
        plain = json.dumps(value, sort_keys=True).encode()
        body = bytes(a ^ b for a, b in zip(plain, self._stream(nonce, len(plain))))
        return base64.urlsafe_b64encode(nonce + body + self._mac("seal", nonce, body)).decode().rstrip("=")

    def open(self, token: str, most: int = 4096) -> dict | None:
        """None for whatever this key didn't seal."""
        try:
            raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)) if len(token) <= most else b""
        except ValueError:
            return None
        if len(raw) < 48:
            return None
        nonce, body, mac = raw[:16], raw[16:-32], raw[-32:]
        if not hmac.compare_digest(mac, self._mac("seal", nonce, body)):
            return None
        return json.loads(bytes(a ^ b for a, b in zip(body, self._stream(nonce, len(body)))))
