"""Signatures, tokens and ciphers over columns, and the policy for keys."""

from __future__ import annotations

import hashlib
import logging
import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text as lower-case hex. The key's pads are literals of the plan: keep plans as secret as the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def ascii_escaped(json: Column) -> Column:
    """JSON text with each character beyond ASCII as \\uXXXX, in two halves beyond the basic plane."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))

    def one(c: Column) -> Column:
        cp = F.ascii(c)
        high = code(F.lit(0xD800) + F.shiftright(cp - 0x10000, 10))
        low = code(F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF)))
        return F.when(cp < 0x80, c).when(cp < 0x10000, code(cp)).otherwise(F.concat(high, low))

    return F.when(json.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json, ""), one), "")).otherwise(json)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Sorted keys, no blanks, nulls kept, ASCII only: the signed form of a record."""
    return ascii_escaped(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}))


def vault_token(pii_type: Column, value: Column, key: bytes) -> Column:
    """[REDACTED_<type>_<16 hex digits>], the same for the same key, type and value."""
    mac = F.left(hmac_sha256(F.concat(pii_type, F.lit(":"), value), key), F.lit(16))
    return F.concat(F.lit("[REDACTED_"), pii_type, F.lit("_"), mac, F.lit("]"))


def encrypt(value: Column, key: bytes) -> Column:
    """AES-256-GCM as lower-case hex of nonce, ciphertext and tag. Only for columns: a literal would be folded to one nonce for all rows."""
    return F.lower(F.hex(F.aes_encrypt(value, F.lit(key), F.lit("GCM"))))


def decrypt(cipher: Column, key: bytes, strict: bool = True) -> Column:
    """The value; a changed ciphertext fails the job, or is null with strict=False."""
    f = F.aes_decrypt if strict else F.try_aes_decrypt
    return f(F.unhex(cipher), F.lit(key), F.lit("GCM")).cast("string")


def load_key(variable: str, env: dict[str, str] | None = None, length: int | None = 32) -> bytes:
    """A key in hex from the environment. In production (VEILSPARK_ENV) a missing key is an error; elsewhere a key derived
    from the variable's name stands in, with a warning. With `length`, any other number of bytes is an error."""
    env = dict(os.environ) if env is None else env
    raw = env.get(variable)
    if not raw:
        if env.get("VEILSPARK_ENV", "").lower() == "production":
            raise RuntimeError(f"{variable} must be set in production")
        logging.getLogger(__name__).warning("%s is not set; a development key is used", variable)
        return hashlib.sha256(b"development:" + variable.encode()).digest()
    try:
        key = bytes.fromhex(raw)
    except ValueError:
        if length is None:
            return raw.encode()
        raise ValueError(f"{variable} must be {length * 2} hex digits") from None
    if length is not None and len(key) != length:
        raise ValueError(f"{variable} must be {length * 2} hex digits")
    return key
