"""Keysets for the encryption functions; the ciphers themselves are Spark's aes_encrypt and aes_decrypt.

A keyset is JSON text as BYTES: a primary key id and keys with base64 material.
Ciphertexts begin with 0x01 and the key's id, then nonce, text and tag.  A key
chain names a key service that cannot be reached from here: wrapped keysets
are taken as they are.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import secrets
import struct


def _load(keyset: bytes) -> dict:
    return json.loads(bytes(keyset))


def _dump(k: dict) -> bytes:
    return json.dumps(k, separators=(",", ":")).encode()


def _key(raw: bytes, kind: str) -> dict:
    return {"keyId": secrets.randbits(32) or 1, "status": "ENABLED", "type": kind, "value": base64.b64encode(raw).decode()}


def new(kind: str) -> bytes:
    if kind.upper() not in ("AEAD_AES_GCM_256", "DETERMINISTIC_AEAD_AES_SIV_CMAC_256"):
        raise ValueError(f"KEYS.NEW_KEYSET: unknown key type {kind}")
    k = _key(secrets.token_bytes(32), kind.upper())
    return _dump({"primaryKeyId": k["keyId"], "key": [k]})


def add_raw(keyset: bytes, kind: str, raw: bytes) -> bytes:
    if len(raw) not in (16, 32):
        raise ValueError("KEYS.ADD_KEY_FROM_RAW_BYTES: a key has 16 or 32 bytes")
    s = _load(keyset)
    s["key"].append(_key(bytes(raw), kind))
    return _dump(s)


def rotate(keyset: bytes, kind: str) -> bytes:
    s, k = _load(keyset), _key(secrets.token_bytes(32), kind.upper())
    return _dump({"primaryKeyId": k["keyId"], "key": [*s["key"], k]})


def length(keyset: bytes) -> int:
    return len(_load(keyset)["key"])


def to_json(keyset: bytes) -> str:
    return json.dumps(_load(keyset), separators=(",", ":"))


def from_json(text: str) -> bytes:
    s = json.loads(text)
    if "key" not in s or "primaryKeyId" not in s:
        raise ValueError("KEYS.KEYSET_FROM_JSON: no keyset")
    return _dump(s)


def primary(keyset: bytes) -> bytes:
    s = _load(keyset)
    return base64.b64decode(next(k["value"] for k in s["key"] if k["keyId"] == s["primaryKeyId"]))


def prefix(keyset: bytes) -> bytes:
    return b"\x01" + struct.pack(">I", _load(keyset)["primaryKeyId"])


def matching(keyset: bytes, text: bytes) -> bytes:
    wanted = struct.unpack(">I", bytes(text[1:5]))[0]
    for k in _load(keyset)["key"]:
        if k["keyId"] == wanted:
            return base64.b64decode(k["value"])
    raise ValueError("no key of the keyset has encrypted this text")


def nonce(key: bytes, aad: bytes, text: bytes) -> bytes:
    """A nonce that depends on key and content alone, for deterministic encryption."""
    return hmac.new(bytes(key), struct.pack(">Q", len(aad)) + bytes(aad) + bytes(text), hashlib.sha256).digest()[:12]


def mac(key: bytes, text: bytes) -> bytes:
    return hmac.new(bytes(key), bytes(text), hashlib.sha256).digest()


#: name: (function, type, whether each call gives another value)
FUNCTIONS = {
    "lk_key_new": (new, "binary", True), "lk_key_add": (add_raw, "binary", True), "lk_key_rotate": (rotate, "binary", True), "lk_key_length": (length, "bigint", False), "lk_key_to_json": (to_json, "string", False), "lk_key_from_json": (from_json, "binary", False),
    "lk_key_primary": (primary, "binary", False), "lk_key_prefix": (prefix, "binary", False), "lk_key_matching": (matching, "binary", False), "lk_key_nonce": (nonce, "binary", False), "lk_hmac": (mac, "binary", False),
}

_C, _K = "CAST({1} AS BINARY)", "{0}"
_OPEN = "aes_decrypt(substring({1}, 6), lk_key_matching({0}, {1}), 'GCM', 'DEFAULT', CAST({2} AS BINARY))"
_DLP_KEY = "lk_hmac(CAST({0} AS BINARY), CAST({3} AS BINARY))"
_DLP_NONCE = "substring(lk_hmac(" + _DLP_KEY + ", concat(CAST({2} AS BINARY), X'00', CAST({3} AS BINARY), X'00', CAST({1} AS BINARY))), 1, 12)"
TEMPLATES = {
    "KEYS.NEW_KEYSET": "lk_key_new({0})", "KEYS.ADD_KEY_FROM_RAW_BYTES": "lk_key_add({0}, {1}, {2})", "KEYS.ROTATE_KEYSET": "lk_key_rotate({0}, {1})", "KEYS.KEYSET_LENGTH": "lk_key_length({0})", "KEYS.KEYSET_TO_JSON": "lk_key_to_json({0})", "KEYS.KEYSET_FROM_JSON": "lk_key_from_json({0})", "KEYS.KEYSET_CHAIN": "{1}",
    "KEYS.NEW_WRAPPED_KEYSET": "lk_key_new({1})", "KEYS.REWRAP_KEYSET": "{2}", "KEYS.ROTATE_WRAPPED_KEYSET": "lk_key_rotate({1}, {2})",
    "AEAD.ENCRYPT": f"concat(lk_key_prefix({_K}), aes_encrypt({_C}, lk_key_primary({_K}), 'GCM', 'DEFAULT', X'', CAST({{2}} AS BINARY)))", "AEAD.DECRYPT_BYTES": _OPEN, "AEAD.DECRYPT_STRING": f"CAST({_OPEN} AS STRING)",
    "DETERMINISTIC_ENCRYPT": f"concat(lk_key_prefix({_K}), aes_encrypt({_C}, lk_key_primary({_K}), 'GCM', 'DEFAULT', lk_key_nonce(lk_key_primary({_K}), CAST({{2}} AS BINARY), {_C}), CAST({{2}} AS BINARY)))", "DETERMINISTIC_DECRYPT_BYTES": _OPEN, "DETERMINISTIC_DECRYPT_STRING": f"CAST({_OPEN} AS STRING)",
    "DLP_KEY_CHAIN": "CAST(to_json(named_struct('resource', {0}, 'wrapped', base64({1}))) AS BINARY)",
    "DLP_DETERMINISTIC_ENCRYPT4": "(SELECT concat(s, '(', length(t), '):', t) FROM (SELECT {2} AS s, base64(aes_encrypt(CAST({1} AS BINARY), " + _DLP_KEY + ", 'GCM', 'DEFAULT', " + _DLP_NONCE + ", CAST({2} AS BINARY))) AS t))",
    "DLP_DETERMINISTIC_DECRYPT4": "CAST(aes_decrypt(unbase64(substring({1}, locate(':', {1}, length({2}) + 1) + 1)), " + _DLP_KEY + ", 'GCM', 'DEFAULT', CAST({2} AS BINARY)) AS STRING)",
}
