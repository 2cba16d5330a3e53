"""Signatures of documents: detached CMS messages over byte ranges, RSA with PKCS #1 v1.5, certificates and their chains.

Reading is for any file; signing is for those who hold a key as numbers. Everything is plain arithmetic on DER values.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass, field
from functools import lru_cache

from quire.functions.content import text_string, to_text_string
from quire.functions.objects import Document, Name, Ref, Stream, decoded, pages, write_incremental
from quire.functions.structure import _terminal_fields

#: Object identifiers of algorithms, attributes and names.
SHA256, SHA384, SHA512, SHA1 = "2.16.840.1.101.3.4.2.1", "2.16.840.1.101.3.4.2.2", "2.16.840.1.101.3.4.2.3", "1.3.14.3.2.26"
RSA, DATA, SIGNED_DATA = "1.2.840.113549.1.1.1", "1.2.840.113549.1.7.1", "1.2.840.113549.1.7.2"
CONTENT_TYPE, MESSAGE_DIGEST, SIGNING_TIME = "1.2.840.113549.1.9.3", "1.2.840.113549.1.9.4", "1.2.840.113549.1.9.5"
COMMON_NAME = "2.5.4.3"
SHA256_WITH_RSA = "1.2.840.113549.1.1.11"
DIGESTS = {SHA1: "sha1", SHA256: "sha256", SHA384: "sha384", SHA512: "sha512", "1.2.840.113549.1.1.5": "sha1", SHA256_WITH_RSA: "sha256", "1.2.840.113549.1.1.12": "sha384", "1.2.840.113549.1.1.13": "sha512"}
MAX_CHAIN = 8


class DerFault(ValueError):
    pass


# --- DER --------------------------------------------------------------------------------------------------------------


@dataclass
class Der:
    """A value: its tag, its body and its whole bytes."""

    tag: int
    body: bytes
    whole: bytes

    def parts(self) -> list[Der]:
        return read_all(self.body)

    def number(self) -> int:
        return int.from_bytes(self.body, "big", signed=True)

    def oid(self) -> str:
        arcs, n = [], 0
        for b in self.body:
            n = n << 7 | b & 127
            if b < 128:
                arcs.append(n)
                n = 0
        if self.tag != 6 or not arcs:
            raise DerFault("no object identifier")
        first = min(arcs[0] // 40, 2)
        return ".".join(map(str, [first, arcs[0] - 40 * first, *arcs[1:]]))


def read(data: bytes, at: int = 0) -> tuple[Der, int]:
    try:
        tag, size, body = data[at], data[at + 1], at + 2
        if size & 128:
            n = size & 127
            if not 0 < n <= 4:
                raise DerFault("length is not definite")
            size, body = int.from_bytes(data[body : body + n], "big"), body + n
    except IndexError:
        raise DerFault("cut off") from None
    if body + size > len(data):
        raise DerFault("cut off")
    return Der(tag, data[body : body + size], data[at : body + size]), body + size


def read_all(data: bytes) -> list[Der]:
    out, at = [], 0
    while at < len(data):
        v, at = read(data, at)
        out.append(v)
    return out


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def sequence(*parts: bytes) -> bytes:
    return der(0x30, *parts)


def integer(n: int) -> bytes:
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))


@lru_cache(256)
def identifier(oid: str) -> bytes:
    a, b, *rest = map(int, oid.split("."))
    out = b""
    for n in (40 * a + b, *rest):
        groups = [n & 127]
        while n := n >> 7:
            groups.append(n & 127 | 128)
        out += bytes(groups[::-1])
    return der(6, out)


def algorithm(oid: str) -> bytes:
    return sequence(identifier(oid), der(5))


# --- keys and certificates -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Key:
    """An RSA key; with its two primes it signs in a quarter of the time."""

    n: int
    e: int
    d: int
    primes: tuple[int, ...] = ()


def _prime(rng: random.Random, bits: int) -> int:
    """A number that passes Miller-Rabin to 24 bases."""
    while True:
        p = rng.getrandbits(bits) | 1 | 3 << bits - 2
        if any(p % q == 0 for q in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
            continue
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for _ in range(24):
            x = pow(rng.randrange(2, p - 1), odd, p)
            if x in (1, p - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                break
        else:
            return p


@lru_cache
def key_for_tests(seed: int, bits: int = 1024) -> Key:
    """A key that anyone can compute again from its seed: for tests and queries only."""
    rng = random.Random(seed)
    p, q = _prime(rng, bits // 2), _prime(rng, bits // 2)
    return Key(p * q, 65537, pow(65537, -1, (p - 1) * (q - 1)), (p, q))


def _padded(digest: str, message: bytes, size: int) -> bytes:
    oid = next(o for o, n in DIGESTS.items() if n == digest)
    info = sequence(algorithm(oid), der(4, hashlib.new(digest, message).digest()))
    return b"\0\1" + b"\xff" * (size - len(info) - 3) + b"\0" + info


def rsa_sign(key: Key, message: bytes, digest: str = "sha256") -> bytes:
    size = (key.n.bit_length() + 7) // 8
    return _private(key, int.from_bytes(_padded(digest, message, size), "big")).to_bytes(size, "big")


@lru_cache(64)
def _halves(key: Key) -> tuple[int, int, int]:
    """The exponents modulo each prime less one, and the second prime's inverse modulo the first."""
    p, q = key.primes
    return key.d % (p - 1), key.d % (q - 1), pow(q, -1, p)


def _private(key: Key, x: int) -> int:
    """x to the private exponent, by the remainder theorem where the primes are known."""
    if len(key.primes) != 2:
        return pow(x, key.d, key.n)
    p, q = key.primes
    dp, dq, inverse = _halves(key)
    b = pow(x % q, dq, q)
    return b + (pow(x % p, dp, p) - b) * inverse % p * q


def rsa_verified(n: int, e: int, message: bytes, signature: bytes, digest: str) -> bool:
    size = (n.bit_length() + 7) // 8
    if len(signature) != size or size < 62:
        return False
    return pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big") == _padded(digest, message, size)


def certificate(subject: str, key: Key, issuer: str, issuer_key: Key, serial: int = 1, valid: tuple[str, str] = ("200101000000Z", "491231235959Z")) -> bytes:
    name = lambda s: sequence(der(0x31, sequence(identifier(COMMON_NAME), der(12, s.encode()))))
    public = sequence(algorithm(RSA), der(3, b"\0", sequence(integer(key.n), integer(key.e))))
    body = sequence(der(0xA0, integer(2)), integer(serial), algorithm(SHA256_WITH_RSA), name(issuer), sequence(*[der(23, v.encode()) for v in valid]), name(subject), public)
    return sequence(body, algorithm(SHA256_WITH_RSA), der(3, b"\0", rsa_sign(issuer_key, body)))


@dataclass
class Certificate:
    serial: int
    issuer: bytes
    subject: bytes
    name: str
    begins: str
    ends: str
    n: int
    e: int
    signed: bytes
    digest: str | None
    signature: bytes

    @classmethod
    def of(cls, data: bytes) -> Certificate:
        """Read once for the documents that share it; nothing changes a certificate after that."""
        return _certificate(data)

    @classmethod
    def _of(cls, data: bytes) -> Certificate:
        body, how, signature = read(data)[0].parts()
        parts = body.parts()
        parts = parts[1:] if parts[0].tag == 0xA0 else parts
        serial, _, issuer, validity, subject, public = parts[:6]
        times = [("20" if t.tag == 23 and t.body < b"50" else "19" if t.tag == 23 else "") + t.body.decode("latin-1") for t in validity.parts()]
        kind, bits = public.parts()
        n = e = 0
        if kind.parts()[0].oid() == RSA:
            n, e = (x.number() for x in read(bits.body[1:])[0].parts())
        common = [a.parts()[1].body for r in subject.parts() for a in r.parts() if a.parts()[0].oid() == COMMON_NAME]
        return cls(serial.number(), issuer.whole, subject.whole, common[-1].decode("utf-8", "replace") if common else "", times[0], times[1], n, e, body.whole, DIGESTS.get(how.parts()[0].oid()), signature.body[1:])

    def issued_by(self, other: Certificate) -> bool:
        return self.issuer == other.subject and other.n > 0 and self.digest is not None and _vouched(other.n, other.e, self.signed, self.signature, self.digest)


@lru_cache(256)
def _certificate(data: bytes) -> Certificate:
    return Certificate._of(data)


#: Many documents are signed by few signers: whether their certificates hold is worked out once.
_vouched = lru_cache(1024)(rsa_verified)


def trusted(leaf: Certificate, others: list[Certificate], roots: list[Certificate], at: str | None = None) -> bool:
    """Whether a chain of valid certificates leads to a root; roots are preferred to what the message brings along."""
    now = leaf
    for _ in range(MAX_CHAIN):
        if at and not now.begins <= at <= now.ends:
            return False
        if any(now.signed == r.signed for r in roots):
            return True
        above = next((c for c in [*roots, *others] if c.signed != now.signed and now.issued_by(c)), None)
        if above is None:
            return False
        now = above
    return False


# --- messages ------------------------------------------------------------------------------------------------------------


def signed_message(content: bytes, key: Key, chain: list[bytes], time: str = "") -> bytes:
    """A detached message by the holder of the first certificate of the chain."""
    own = Certificate.of(chain[0])
    attributes = [sequence(identifier(CONTENT_TYPE), der(0x31, identifier(DATA))), sequence(identifier(MESSAGE_DIGEST), der(0x31, der(4, hashlib.sha256(content).digest())))]
    attributes += [sequence(identifier(SIGNING_TIME), der(0x31, der(23, time.encode())))] if time else []
    body = b"".join(sorted(attributes))
    signer = sequence(integer(1), sequence(own.issuer, integer(own.serial)), algorithm(SHA256), der(0xA0, body), algorithm(RSA), der(4, rsa_sign(key, der(0x31, body))))
    return sequence(identifier(SIGNED_DATA), der(0xA0, sequence(integer(1), der(0x31, algorithm(SHA256)), sequence(identifier(DATA)), der(0xA0, *chain), der(0x31, signer))))


@dataclass
class Verdict:
    signer: str = ""
    digest: str = ""
    intact: bool = False
    authentic: bool = False
    trusted: bool = False
    time: str | None = None
    fault: str | None = None
    certificates: list[Certificate] = field(default_factory=list)


def verified(message: bytes, content: bytes, roots: list[Certificate] = ()) -> Verdict:
    """intact: the content has the signed digest; authentic: the signer's key signed it; trusted: by a chain to a root."""
    out = Verdict()
    try:
        kind, wrapped = read(message)[0].parts()
        if kind.oid() != SIGNED_DATA:
            raise DerFault("no signed data")
        parts = read(wrapped.body)[0].parts()
        out.certificates = [Certificate.of(c.whole) for p in parts if p.tag == 0xA0 for c in p.parts() if c.tag == 0x30]
        info = parts[-1].parts()[0].parts()
        who, how = info[1], info[2]
        out.digest = DIGESTS.get(how.parts()[0].oid(), "")
        attributes = next((p for p in info[3:] if p.tag == 0xA0), None)
        signature = next(p.body for p in info[3:] if p.tag == 4)
        issuer, serial = who.parts()
        own = next((c for c in out.certificates if c.issuer == issuer.whole and c.serial == serial.number()), None)
        if own is None or not out.digest:
            raise DerFault("signer or digest not known")
        out.signer = own.name
        signed, want = content, None
        if attributes is not None:
            found = {a.parts()[0].oid(): a.parts()[1].parts()[0] for a in attributes.parts()}
            want = found[MESSAGE_DIGEST].body if MESSAGE_DIGEST in found else b""
            out.time = found[SIGNING_TIME].body.decode("latin-1") if SIGNING_TIME in found else None
            signed = der(0x31, attributes.body)
        out.authentic = own.n > 0 and rsa_verified(own.n, own.e, signed, signature, out.digest)
        out.intact = out.authentic if want is None else want == hashlib.new(out.digest, content).digest()
        out.trusted = out.authentic and trusted(own, out.certificates, list(roots), ("20" + out.time) if out.time else None)
    except (DerFault, ValueError, IndexError, StopIteration) as e:
        out.fault = str(e) or type(e).__name__
    return out


# --- documents -----------------------------------------------------------------------------------------------------------


def signature_fields(doc: Document) -> list[dict]:
    """Fields of signatures that are signed: name, dictionary, message and byte ranges."""
    out = []
    for _, name, kind, value, _, _ in _terminal_fields(doc):
        v = doc.dict_of(value)
        ranges, message = doc.resolve(v.get("ByteRange")), doc.resolve(v.get("Contents"))
        if kind == "Sig" and isinstance(message, bytes) and isinstance(ranges, list) and len(ranges) % 2 == 0 and all(type(x) is int and x >= 0 for x in ranges):
            out.append({"name": name, "dict": v, "message": message, "ranges": list(zip(ranges[::2], ranges[1::2], strict=True))})
    return out


def vri_key(message: bytes) -> str:
    """A signature's key in the security store."""
    return hashlib.sha1(message).hexdigest().upper()


def signatures(doc: Document, roots: list[Certificate] = ()) -> list[dict]:
    """A row for each signed field: who signed, what it covers, and whether it holds."""
    out = []
    for f in signature_fields(doc):
        content = b"".join(doc.data[a : a + n] for a, n in f["ranges"])
        v = verified(f["message"], content, roots)
        last = f["ranges"][-1] if f["ranges"] else (0, 0)
        key = vri_key(f["message"])
        reason = doc.resolve(f["dict"].get("Reason"))
        out.append({"name": f["name"], "signer": v.signer, "digest": v.digest, "intact": v.intact, "authentic": v.authentic, "trusted": v.trusted, "covers_file": sum(last) == len(doc.data), "vri_key": key, "reason": text_string(reason) if isinstance(reason, bytes) else None, "fault": v.fault})
    return out


def validation_info(doc: Document) -> list[dict]:
    """What the security store holds for each signature, by its key; "" for what all share."""
    store = doc.dict_of(doc.catalog.get("DSS"))
    sizes = lambda d, key: [len(decoded(s)) for x in doc.resolve(d.get(key)) or [] if isinstance(s := doc.resolve(x), Stream)]
    rows = [("", store, ("Certs", "CRLs", "OCSPs"))] if store else []
    rows += [(k, doc.dict_of(v), ("Cert", "CRL", "OCSP")) for k, v in doc.dict_of(store.get("VRI")).items()]
    return [{"vri_key": k, "n_certificates": len(sizes(d, names[0])), "n_crls": len(sizes(d, names[1])), "n_ocsps": len(sizes(d, names[2]))} for k, d, names in rows]


#: Bytes that a message has room for.
_HOLE = 8192


def signed(doc: Document, key: Key, chain: list[bytes], name: str = "Signature1", reason: str = "", time: str = "") -> bytes:
    """The original bytes and a new revision with a signed field; the signature covers all but its own place."""
    first, page = pages(doc)[0]
    top = max([*doc.xref, 0])
    form = dict(doc.dict_of(doc.catalog.get("AcroForm")))
    value = {"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": [0, 1_999_999_999, 1_999_999_999, 1_999_999_999], "Contents": bytes(_HOLE), **({"Reason": to_text_string(reason)} if reason else {})}
    widget = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Sig"), "T": to_text_string(name), "V": Ref(top + 1), "Rect": [0, 0, 0, 0], "F": 132, "P": Ref(first)}
    form |= {"Fields": [*(doc.resolve(form.get("Fields")) or []), Ref(top + 2)], "SigFlags": 3}
    own = {**doc.get(first), "Annots": [*(doc.resolve(page.get("Annots")) or []), Ref(top + 2)]}
    changed = {top + 1: value, top + 2: widget, first: own, doc.trailer["Root"].num: {**doc.catalog, "AcroForm": form}}
    data = write_incremental(doc.data, changed, doc)
    at = data.index(b"<" + b"00" * _HOLE + b">", len(doc.data))
    after = at + 2 * _HOLE + 2
    said = b"[0 1999999999 1999999999 1999999999]"
    place = data.index(said, len(doc.data))
    ranges = (b"[0 %d %d %d]" % (at, after, len(data) - after)).ljust(len(said))
    data = data[:place] + ranges + data[place + len(said) :]
    message = signed_message(data[:at] + data[after:], key, chain, time)
    if len(message) > _HOLE:
        raise ValueError("the message is larger than its place")
    return data[: at + 1] + message.hex().encode().ljust(2 * _HOLE, b"0") + data[after - 1 :]


def with_validation(doc: Document, certificates: list[bytes], crls: list[bytes] = (), ocsps: list[bytes] = ()) -> bytes:
    """A new revision with a security store: what is given, for all signatures and for each by its key."""
    top = max([*doc.xref, 0])
    changed: dict[int, object] = {}

    def add(v) -> Ref:
        changed[top + len(changed) + 1] = v
        return Ref(top + len(changed))

    refs = {k: [add(Stream({}, x)) for x in found] for k, found in (("Cert", certificates), ("CRL", crls), ("OCSP", ocsps))}
    keys = [vri_key(f["message"]) for f in signature_fields(doc)]
    store = {"Type": Name("DSS"), **{f"{k}s": v for k, v in refs.items() if v}, "VRI": {k: {x: v for x, v in refs.items() if v} for k in keys}}
    changed[doc.trailer["Root"].num] = {**doc.catalog, "DSS": add(store)}
    return write_incremental(doc.data, changed, doc)

