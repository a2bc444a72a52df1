"""Maps under a passphrase: AES-256-GCM by the JVM's cipher, keys by scrypt or Argon2id.

Argon2id needs a function; without one (``argon2``), keys are made by scrypt.
Everything about an envelope is checked before a key is made.  A JVM can't
promise that secrets leave its memory; keep maps out of caches.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import os
import secrets
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FORMAT = "maskweave-mapping"
VERSION = 2
CIPHER = "AES-256-GCM"
SCRYPT = {"n": 2**15, "r": 8, "p": 1}
ARGON2 = {"iterations": 2, "lanes": 1, "memory_kib": 19_456}
MOST = {"n": 2**20, "r": 32, "p": 16, "iterations": 10, "lanes": 8, "memory_kib": 1 << 20}
MOST_BYTES = 256 << 20
KEY_ENV = "MASKWEAVE_MAPPING_KEY"

#: (password, salt, iterations, lanes, memory in KiB) -> 32 bytes; set it where a library is installed.
argon2: Callable[[bytes, bytes, int, int, int], bytes] | None = None


def passphrase(given: str | None = None) -> str | None:
    """The given one, else that of the environment."""
    return given or os.environ.get(KEY_ENV) or None


def is_envelope(data: object) -> bool:
    return isinstance(data, dict) and hmac.compare_digest(str(data.get("format", "")).encode(), FORMAT.encode()) and "ciphertext" in data


def sha256_of(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def bound_text(source_sha256: str, schema: int = 1, version: int = VERSION) -> bytes:
    """What is authenticated with a map, in lines, so that no spacing can change it."""
    return f"{FORMAT}\nv={version}\nschema={schema}\nsha256={source_sha256}\n".encode()


def _sha(value: str | None) -> str:
    v = (value or "").strip().lower()
    if v and (len(v) != 64 or set(v) - set("0123456789abcdef")):
        raise ValueError("a SHA-256 has 64 hexadecimal digits")
    return v


def _bytes(data: dict, name: str, size: int | None) -> bytes:
    try:
        out = base64.b64decode(str(data.get(name, "")), validate=True)
    except (binascii.Error, ValueError) as e:
        raise ValueError(f"{name} is no base64") from e
    if size is not None and len(out) != size or not out or len(out) > MOST_BYTES:
        raise ValueError(f"{name} has a wrong length")
    return out


def check(data: object) -> dict:
    """The parts of an envelope; ValueError for anything unexpected, before any key is made."""
    if not is_envelope(data):
        raise ValueError("this is no encrypted map")
    if data.get("v") != VERSION or isinstance(data.get("v"), bool):
        raise ValueError("unknown version")
    if data.get("cipher") != CIPHER:
        raise ValueError("unknown cipher")
    kdf, params = data.get("kdf"), data.get("kdf_params")
    names = {"scrypt": SCRYPT, "argon2id": ARGON2}.get(kdf)
    if names is None or not isinstance(params, dict) or set(params) != set(names):
        raise ValueError("unknown key derivation")
    for name, value in params.items():
        if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= MOST[name]:
            raise ValueError(f"{name} is out of range")
    bound = data.get("aad")
    if not isinstance(bound, dict) or not isinstance(bound.get("schema_version"), int) or not 1 <= bound["schema_version"] <= 16:
        raise ValueError("the bound data are missing or out of range")
    return {
        "kdf": kdf, "params": params, "salt": _bytes(data, "salt", 16), "nonce": _bytes(data, "nonce", 12), "ciphertext": _bytes(data, "ciphertext", None),
        "source": _sha(bound.get("source_sha256")), "schema": bound["schema_version"],
    }


def _key(secret: str, kdf: str, params: dict, salt: bytes) -> bytes:
    if not secret:
        raise ValueError("a passphrase is needed")
    if kdf == "scrypt":
        return hashlib.scrypt(secret.encode(), salt=salt, n=params["n"], r=params["r"], p=params["p"], dklen=32, maxmem=256 * params["n"] * params["r"])
    if argon2 is None:
        raise ValueError("Argon2id is not available here; set maskweave.crypto.argon2")
    return argon2(secret.encode(), salt, params["iterations"], params["lanes"], params["memory_kib"])


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    return spark or SparkSession.builder.getOrCreate()


def encrypt(originals: dict[str, str], secret: str, source_sha256: str = "", schema: int = 1) -> dict:
    """An envelope of a map, bound to the SHA-256 of its source."""
    kdf, params = ("argon2id", ARGON2) if argon2 else ("scrypt", SCRYPT)
    salt, nonce, source = secrets.token_bytes(16), secrets.token_bytes(12), _sha(source_sha256)
    key = _key(secret, kdf, params, salt)
    row = _session().createDataFrame([(json.dumps(originals, ensure_ascii=False).encode(), key, nonce, bound_text(source, schema))], "t binary, k binary, n binary, a binary")
    sealed = bytes(row.select(F.aes_encrypt("t", "k", F.lit("GCM"), F.lit("NONE"), "n", "a")).first()[0])[12:]  # the JVM puts the nonce first
    b64 = lambda b: base64.b64encode(b).decode()
    return {"format": FORMAT, "v": VERSION, "kdf": kdf, "cipher": CIPHER, "kdf_params": dict(params), "salt": b64(salt), "nonce": b64(nonce), "ciphertext": b64(sealed), "aad": {"source_sha256": source, "schema_version": schema}}


def decrypt(envelope: dict, secret: str, source_sha256: str | None = None) -> dict[str, str]:
    """The map; ValueError if the passphrase or the source is wrong or anything was changed."""
    e = check(envelope)
    if source_sha256 is not None and not hmac.compare_digest(_sha(source_sha256), e["source"]):
        raise ValueError("the map belongs to another source")
    key = _key(secret, e["kdf"], e["params"], e["salt"])
    row = _session().createDataFrame([(e["nonce"] + e["ciphertext"], key, bound_text(e["source"], e["schema"]))], "t binary, k binary, a binary")
    opened = row.select(F.try_aes_decrypt("t", "k", F.lit("GCM"), F.lit("NONE"), "a")).first()[0]
    if opened is None:
        raise ValueError("wrong passphrase, or the file was changed")
    out = json.loads(bytes(opened))
    if not isinstance(out, dict):
        raise ValueError("the file holds no map")
    return out
