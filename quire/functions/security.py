"""Standard security handlers: RC4 and AES in pure Python, key derivation, unlocking on open and encrypting on save."""

from __future__ import annotations

import hashlib

from quire.functions.objects import Document, Name, Stream, SyntaxFault

#: The padding string of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _boxes() -> tuple[bytes, bytes]:
    """The S-box from its rule: the inverse in GF(2^8), then the affine map."""
    p = q = 1
    box = bytearray(256)
    while True:
        p ^= (p << 1 & 255) ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1 & 255
        q ^= q << 2 & 255
        q ^= q << 4 & 255
        if q & 0x80:
            q ^= 0x09
        x = q
        for k in range(1, 5):
            x ^= (q << k | q >> 8 - k) & 255
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_S, _R = _boxes()


def _mul(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1 ^ (0x11B if a & 0x80 else 0)) & 0x1FF
        b >>= 1
    return out


_M = {k: bytes(_mul(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


class AES:
    def __init__(self, key: bytes):
        n = len(key) // 4
        w = [key[i : i + 4] for i in range(0, len(key), 4)]
        r = 1
        for i in range(n, 4 * (n + 7)):
            t = w[-1]
            if i % n == 0:
                t = bytes(_S[b] for b in t[1:] + t[:1])
                t = bytes([t[0] ^ r]) + t[1:]
                r = _M[2][r]
            elif n > 6 and i % n == 4:
                t = bytes(_S[b] for b in t)
            w.append(bytes(a ^ b for a, b in zip(w[i - n], t, strict=True)))
        self.keys = [b"".join(w[i : i + 4]) for i in range(0, len(w), 4)]

    def encrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        for key in self.keys[1:-1]:
            s = [_S[s[i]] for i in _SHIFT]
            out = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                out += [_M[2][a] ^ _M[3][b] ^ d ^ e, a ^ _M[2][b] ^ _M[3][d] ^ e, a ^ b ^ _M[2][d] ^ _M[3][e], _M[3][a] ^ b ^ d ^ _M[2][e]]
            s = [a ^ b for a, b in zip(out, key, strict=True)]
        return bytes(_S[s[i]] ^ k for i, k in zip(_SHIFT, self.keys[-1], strict=True))

    def decrypt_block(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for key in self.keys[-2:0:-1]:
            s = [_R[s[i]] ^ k for i, k in zip(_BACK, key, strict=True)]
            out = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                out += [_M[14][a] ^ _M[11][b] ^ _M[13][d] ^ _M[9][e], _M[9][a] ^ _M[14][b] ^ _M[11][d] ^ _M[13][e], _M[13][a] ^ _M[9][b] ^ _M[14][d] ^ _M[11][e], _M[11][a] ^ _M[13][b] ^ _M[9][d] ^ _M[14][e]]
            s = out
        return bytes(_R[s[i]] ^ k for i, k in zip(_BACK, self.keys[0], strict=True))


def cbc_encrypt_nopad(key: bytes, iv: bytes, data: bytes) -> bytes:
    a, out = AES(key), bytearray()
    for i in range(0, len(data), 16):
        iv = a.encrypt_block(bytes(x ^ y for x, y in zip(data[i : i + 16], iv, strict=True)))
        out += iv
    return bytes(out)


def cbc_decrypt_nopad(key: bytes, iv: bytes, data: bytes) -> bytes | None:
    if len(data) % 16:
        return None
    a, out = AES(key), bytearray()
    for i in range(0, len(data), 16):
        out += bytes(x ^ y for x, y in zip(a.decrypt_block(data[i : i + 16]), iv, strict=True))
        iv = data[i : i + 16]
    return bytes(out)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """The vector, then the padded text's blocks."""
    n = 16 - len(data) % 16
    return iv + cbc_encrypt_nopad(key, iv, data + bytes([n]) * n)


def cbc_decrypt(key: bytes, data: bytes) -> bytes | None:
    out = cbc_decrypt_nopad(key, data[:16], data[16:]) if len(data) >= 32 else None
    n = out[-1] if out else 0
    return out[:-n] if out and 1 <= n <= 16 and out.endswith(bytes([n]) * n) else None


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The iterated hash of revision 6."""
    k, n = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = cbc_encrypt_nopad(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


def derive_key(password: bytes, owner: bytes, permissions: int, id0: bytes, revision: int, length: int, metadata: bool = True) -> bytes:
    h = hashlib.md5((password + PAD)[:32] + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + id0 + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:length]).digest()
    return h[:length]


def _user_entry(key: bytes, id0: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    u = rc4(key, hashlib.md5(PAD + id0).digest())
    for i in range(1, 20):
        u = rc4(bytes(b ^ i for b in key), u)
    return u


def _owner_key(password: bytes, revision: int, length: int) -> bytes:
    h = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h).digest()
    return h[:length]


def object_key(key: bytes, num: int, gen: int, aes: bool) -> bytes:
    return hashlib.md5(key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()[: min(len(key) + 5, 16)]


def file_key(encrypt: dict, id0: bytes, password: bytes) -> bytes | None:
    """The file's key by the user password, then by the owner password; None if neither opens it."""
    v, r = encrypt.get("V", 0), encrypt.get("R", 0)
    o, u, p = encrypt.get("O", b""), encrypt.get("U", b""), encrypt.get("P", 0)
    if v == 5:
        digest = (lambda pw, salt, more=b"": hash_r6(pw, salt, more)) if r >= 6 else (lambda pw, salt, more=b"": hashlib.sha256(pw + salt + more).digest())
        pw = password[:127]
        if digest(pw, u[32:40]) == u[:32]:
            return cbc_decrypt_nopad(digest(pw, u[40:48]), bytes(16), encrypt["UE"][:32])
        if digest(pw, o[32:40], u[:48]) == o[:32]:
            return cbc_decrypt_nopad(digest(pw, o[40:48], u[:48]), bytes(16), encrypt["OE"][:32])
        return None
    length = encrypt.get("Length", 40) // 8 if v > 1 else 5
    if v == 4:
        length = 16
    meta = encrypt.get("EncryptMetadata", True)
    candidates = [password]
    ok = _owner_key(password, r, length)
    owner = o[:32]
    for i in range(19, -1, -1) if r >= 3 else [0]:
        owner = rc4(bytes(b ^ i for b in ok), owner)
    candidates.append(owner)
    for c in candidates:
        key = derive_key(c, o, p, id0, r, length, meta)
        expected = _user_entry(key, id0, r)
        if expected[:16] == u[:16]:
            return key
    return None


def supports(encrypt: dict) -> bool:
    """Whether the standard handler can open a file with this dictionary: wrong passwords are told apart from other handlers."""
    v = encrypt.get("V", 0)
    if encrypt.get("Filter") != "Standard" or v not in (1, 2, 4, 5):
        return False
    filters, used = encrypt.get("CF"), encrypt.get("StmF")
    method = filters.get(used, {}).get("CFM") if v == 4 and isinstance(filters, dict) else None
    return v != 4 or method in ("V2", "AESV2") or used == "Identity"


def unlock(doc: Document, password: bytes) -> None:
    """Sets the document's decryption; raises SyntaxFault where the password doesn't open it."""
    ref = doc.trailer["Encrypt"]
    encrypt = doc.dict_of(ref)
    ids = doc.resolve(doc.trailer.get("ID")) or [b""]
    if encrypt.get("Filter") != "Standard" or encrypt.get("V") not in (1, 2, 4, 5):
        raise SyntaxFault("security handler not supported")
    key = file_key(encrypt, ids[0], password)
    if key is None:
        raise SyntaxFault("wrong password")
    v = encrypt["V"]
    method = str(doc.dict_of(doc.dict_of(encrypt.get("CF")).get("StdCF")).get("CFM", "V2")) if v >= 4 else "V2"
    if str(encrypt.get("StmF", "StdCF")) == "Identity":
        method = "None"

    def plain(num: int, gen: int, data: bytes) -> bytes:
        if method == "None":
            return data
        if v == 5:
            return cbc_decrypt(key, data) or b""
        own = object_key(key, num, gen, method == "AESV2")
        return (cbc_decrypt(own, data) or b"") if method == "AESV2" else rc4(own, data)

    def walk(num: int, gen: int, x, inside: str = ""):
        if isinstance(x, bytes):
            return plain(num, gen, x)
        if isinstance(x, list):
            return [walk(num, gen, y) for y in x]
        if isinstance(x, dict):
            signature = "ByteRange" in x  # a signature's bytes are never encrypted
            return {k: y if signature and k == "Contents" else walk(num, gen, y) for k, y in x.items()}
        if isinstance(x, Stream):
            if x.dict.get("Type") == "XRef":
                return x
            first = x.dict.get("Filter")
            first = first[0] if isinstance(first, list) and first else first
            return Stream(walk(num, gen, x.dict), x.raw if first == "Crypt" else plain(num, gen, x.raw))
        return x

    doc.exempt = ref.num if hasattr(ref, "num") else None
    doc.cache.clear()
    doc.decrypt = walk


def encrypted(doc: Document, user: bytes, owner: bytes, permissions: int = -4, algorithm: str = "aes128", seed: bytes = b"") -> bytes:
    """The document written anew, encrypted: rc4 (128 bits), aes128 or aes256 (revision 6). Salts and vectors derive from the seed."""
    from quire.functions.objects import Ref, file_id, write

    objects = dict(doc.live())
    id0 = file_id(doc.data)
    stir = lambda what, n: hashlib.sha512(seed + what.encode() + id0).digest()[:n]
    if algorithm == "aes256":
        key, us, os_ = stir("key", 32), stir("user", 16), stir("owner", 16)
        u = hash_r6(user, us[:8]) + us
        o = hash_r6(owner, os_[:8], u) + os_
        ue = cbc_encrypt_nopad(hash_r6(user, us[8:]), bytes(16), key)
        oe = cbc_encrypt_nopad(hash_r6(owner, os_[8:], u), bytes(16), key)
        perms = AES(key).encrypt_block((permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + stir("perms", 4))
        encrypt = {"Filter": Name("Standard"), "V": 5, "R": 6, "Length": 256, "O": o, "U": u, "OE": oe, "UE": ue, "P": permissions, "Perms": perms, "CF": {"StdCF": {"CFM": Name("AESV3"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    else:
        r = 4 if algorithm == "aes128" else 3
        o = (user + PAD)[:32]
        for i in range(20):
            o = rc4(bytes(b ^ i for b in _owner_key(owner or user, r, 16)), o)
        key = derive_key(user, o, permissions, id0, r, 16)
        encrypt = {"Filter": Name("Standard"), "V": r if r == 4 else 2, "R": r, "Length": 128, "O": o, "U": _user_entry(key, id0, r) + bytes(16), "P": permissions}
        if r == 4:
            encrypt |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def seal(num: int, data: bytes) -> bytes:
        iv = hashlib.md5(seed + id0 + num.to_bytes(4, "big") + hashlib.md5(data).digest()).digest()
        if algorithm == "aes256":
            return cbc_encrypt(key, iv, data)
        own = object_key(key, num, 0, algorithm == "aes128")
        return cbc_encrypt(own, iv, data) if algorithm == "aes128" else rc4(own, data)

    def walk(num: int, x):
        if isinstance(x, bytes):
            return seal(num, x)
        if isinstance(x, list):
            return [walk(num, y) for y in x]
        if isinstance(x, dict):
            return {k: walk(num, y) for k, y in x.items()}
        return Stream(walk(num, x.dict), seal(num, x.raw)) if isinstance(x, Stream) else x

    out = {n: walk(n, v) for n, v in objects.items()}
    number = max(out) + 1
    out[number] = encrypt
    info = doc.trailer.get("Info")
    version = (2, 0) if algorithm == "aes256" else (1, 6)
    more = {"Encrypt": Ref(number), "ID": [id0, id0]}
    return write(out, doc.trailer["Root"].num, info.num if isinstance(info, Ref) else None, (1, 7) if version == (2, 0) else version, more=more)
