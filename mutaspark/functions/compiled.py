"""Ed25519 by the system's libcrypto (OpenSSL 1.1.1 or later), through its documented C interface; None where there is no such library."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools

#: OpenSSL's number of the key type.
ED25519 = 1087


@functools.cache
def library() -> ctypes.CDLL | None:
    for name in (ctypes.util.find_library("crypto"), "libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.dylib"):
        try:
            lib = ctypes.CDLL(name) if name else None
        except OSError:
            continue
        if lib is not None and hasattr(lib, "EVP_PKEY_new_raw_public_key") and hasattr(lib, "EVP_DigestVerify"):
            break
    else:
        return None
    place, size = ctypes.c_void_p, ctypes.c_size_t
    kinds = {
        "EVP_PKEY_new_raw_public_key": (place, [ctypes.c_int, place, ctypes.c_char_p, size]), "EVP_PKEY_new_raw_private_key": (place, [ctypes.c_int, place, ctypes.c_char_p, size]),
        "EVP_PKEY_free": (None, [place]), "EVP_MD_CTX_new": (place, []), "EVP_MD_CTX_free": (None, [place]), "ERR_clear_error": (None, []),
        "EVP_DigestVerifyInit": (ctypes.c_int, [place] * 5), "EVP_DigestVerify": (ctypes.c_int, [place, ctypes.c_char_p, size, ctypes.c_char_p, size]),
        "EVP_DigestSignInit": (ctypes.c_int, [place] * 5), "EVP_DigestSign": (ctypes.c_int, [place, ctypes.c_char_p, ctypes.POINTER(size), ctypes.c_char_p, size]),
    }
    for name, (result, arguments) in kinds.items():
        getattr(lib, name).restype, getattr(lib, name).argtypes = result, arguments
    return lib


class _Key:
    """A key that lives as long as this object."""

    def __init__(self, raw: bytes, private: bool):
        self.lib = library()
        make = self.lib.EVP_PKEY_new_raw_private_key if private else self.lib.EVP_PKEY_new_raw_public_key
        self.place = make(ED25519, None, raw, len(raw)) if len(raw) == 32 else None

    def __del__(self):
        if self.place:
            self.lib.EVP_PKEY_free(self.place)


@functools.lru_cache(maxsize=4096)
def _key(raw: bytes, private: bool) -> _Key:
    return _Key(raw, private)


def verifies(public: bytes, message: bytes, signature: bytes) -> bool:
    lib, key = library(), _key(public, False)
    if not key.place or len(signature) != 64:
        return False
    context = lib.EVP_MD_CTX_new()
    try:
        good = lib.EVP_DigestVerifyInit(context, None, None, None, key.place) == 1 and lib.EVP_DigestVerify(context, signature, 64, message, len(message)) == 1
        if not good:
            lib.ERR_clear_error()
        return good
    finally:
        lib.EVP_MD_CTX_free(context)


def sign(seed: bytes, message: bytes) -> bytes:
    lib, key = library(), _key(seed, True)
    context, out, size = lib.EVP_MD_CTX_new(), ctypes.create_string_buffer(64), ctypes.c_size_t(64)
    try:
        if lib.EVP_DigestSignInit(context, None, None, None, key.place) != 1 or lib.EVP_DigestSign(context, out, ctypes.byref(size), message, len(message)) != 1:
            lib.ERR_clear_error()
            raise ValueError("libcrypto can't sign with this seed")
        return out.raw
    finally:
        lib.EVP_MD_CTX_free(context)
