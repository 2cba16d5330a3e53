"""Functions of documents: sampled, exponential, stitching and calculator functions, on lists of numbers."""

from __future__ import annotations

import itertools
import math
import re

from quire.functions.objects import Document, Stream, decoded

MAX_STEPS = 100_000
MAX_DEPTH = 8


def parse(doc: Document, v, depth: int = 0):
    """A callable list -> list, or None where the function is malformed."""
    v = doc.resolve(v)
    d = v.dict if isinstance(v, Stream) else v
    if not isinstance(d, dict) or depth > MAX_DEPTH:
        return None
    domain, range_ = _pairs(d.get("Domain")), _pairs(d.get("Range"))
    kind = d.get("FunctionType")
    if not domain:
        return None
    if kind == 2:
        c0, c1, n = d.get("C0", [0.0]), d.get("C1", [1.0]), d.get("N", 1)
        body = lambda x: [a + x[0] ** n * (b - a) if x[0] or n >= 0 else a for a, b in zip(c0, c1, strict=False)]
    elif kind == 3:
        parts = [parse(doc, f, depth + 1) for f in doc.resolve(d.get("Functions")) or []]
        bounds, encode = d.get("Bounds", []), _pairs(d.get("Encode"))
        if not parts or None in parts or len(encode) < len(parts):
            return None
        body = lambda x: stitched(x[0], parts, bounds, encode, domain[0])
    elif kind == 0 and isinstance(v, Stream) and range_:
        size, bits = d.get("Size", []), d.get("BitsPerSample", 8)
        encode = _pairs(d.get("Encode")) or [(0, s - 1) for s in size]
        samples = unpack(decoded(v), bits)
        decode = _pairs(d.get("Decode")) or range_
        body = lambda x: sampled(x, domain, size, encode, samples, decode, (1 << bits) - 1)
    elif kind == 4 and isinstance(v, Stream) and range_:
        program = tokens(decoded(v).decode("latin-1"))
        if program is None:
            return None
        body = lambda x: run(program, x, len(range_))
    else:
        return None

    def call(x: list[float]) -> list[float]:
        x = [min(max(x[i] if i < len(x) else lo, lo), hi) for i, (lo, hi) in enumerate(domain)]
        out = body(x)
        return [min(max(y, range_[i][0]), range_[i][1]) if i < len(range_) else y for i, y in enumerate(out)]

    return call


def _pairs(v) -> list[tuple[float, float]]:
    return list(zip(v[::2], v[1::2], strict=False)) if isinstance(v, list) else []


def stitched(x: float, parts, bounds, encode, domain) -> list[float]:
    i = sum(x >= b for b in bounds[: len(parts) - 1])
    edges = [domain[0], *bounds, domain[1]]
    lo, hi = edges[i], edges[i + 1]
    a, b = encode[i]
    return parts[i]([a if hi == lo else a + (x - lo) * (b - a) / (hi - lo)])


def unpack(data: bytes, bits: int) -> list[int]:
    if bits % 8 == 0:
        w = bits // 8
        return [int.from_bytes(data[i : i + w], "big") for i in range(0, len(data) - w + 1, w)]
    n = int.from_bytes(data, "big")
    total = len(data) * 8
    return [n >> total - (i + 1) * bits & (1 << bits) - 1 for i in range(total // bits)]


def sampled(x, domain, size, encode, samples, decode, top) -> list[float]:
    """Linear between the corners around the point."""
    m, n = len(size), len(decode)
    if m > MAX_DEPTH:
        return [lo for lo, _ in decode]
    low, part = [], []
    for v, (a, b), s, (c, d) in zip(x, domain, size, encode, strict=False):
        e = c + (v - a) * (d - c) / (b - a) if b != a else c
        e = min(max(e, 0), s - 1)
        i = min(int(math.floor(e)), max(0, s - 2))
        low.append(i)
        part.append(e - i)
    out = []
    for j in range(n):
        sum_ = 0.0
        for corner in itertools.product((0, 1), repeat=m):
            weight, at, stride = 1.0, 0, 1
            for k in range(m):
                weight *= part[k] if corner[k] else 1 - part[k]
                at += min(low[k] + corner[k], size[k] - 1) * stride
                stride *= size[k]
            if weight and at * n + j < len(samples):
                sum_ += weight * samples[at * n + j]
        lo, hi = decode[j]
        out.append(lo + sum_ * (hi - lo) / top)
    return out


def tokens(text: str):
    """A program as nested lists, or None where braces don't match."""
    stack: list[list] = [[]]
    for t in re.findall(r"[{}]|[^\s{}]+", re.sub(r"%[^\r\n]*", "", text)):
        if t == "{":
            stack.append([])
        elif t == "}":
            if len(stack) < 2:
                return None
            done = stack.pop()
            stack[-1].append(done)
        else:
            try:
                stack[-1].append(int(t) if re.fullmatch(r"[+-]?\d+", t) else float(t))
            except ValueError:
                stack[-1].append(t)
    return stack[0][0] if len(stack) == 1 and stack[0] and isinstance(stack[0][0], list) else None


def _whole(f):
    return lambda a, b: 0 if int(b) == 0 else f(int(a), int(b))


def _half_up(x: float) -> float:
    return math.floor(x + 0.5)


_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0,
    "idiv": _whole(lambda a, b: int(a / b)), "mod": _whole(lambda a, b: int(math.fmod(a, b))), "exp": lambda a, b: a**b if a > 0 or b == int(b) and (a or b >= 0) else 0.0,
    "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": lambda a, b: a and b if isinstance(a, bool) else int(a) & int(b), "or": lambda a, b: a or b if isinstance(a, bool) else int(a) | int(b),
    "xor": lambda a, b: a != b if isinstance(a, bool) else int(a) ^ int(b), "bitshift": lambda a, b: int(a) << min(int(b), 31) if b >= 0 else int(a) >> min(-int(b), 63),
}
_ONE = {
    "neg": lambda a: -a, "abs": abs, "sqrt": lambda a: math.sqrt(max(a, 0)), "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
    "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0, "cvi": int, "cvr": float, "floor": math.floor, "ceiling": math.ceil,
    "round": _half_up, "truncate": math.trunc, "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}


def run(program: list, x: list[float], outputs: int) -> list[float]:
    """The last `outputs` numbers on the stack; missing ones, and all after a fault, are 0."""
    stack: list = list(x)
    left = MAX_STEPS

    def go(body: list) -> None:
        nonlocal left
        for i, t in enumerate(body):
            left -= 1
            if left < 0:
                raise ValueError("too many steps")
            if isinstance(t, list):
                continue
            if isinstance(t, (int, float)):
                stack.append(t)
            elif t in _TWO:
                b, a = stack.pop(), stack.pop()
                stack.append(_TWO[t](a, b))
            elif t in _ONE:
                stack.append(_ONE[t](stack.pop()))
            elif t in ("true", "false"):
                stack.append(t == "true")
            elif t == "pop":
                stack.pop()
            elif t == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif t == "dup":
                stack.append(stack[-1])
            elif t == "copy":
                n = int(stack.pop())
                stack.extend(stack[len(stack) - n :] if 0 < n <= len(stack) else [])
            elif t == "index":
                stack.append(stack[-1 - int(stack.pop())])
            elif t == "roll":
                j, n = int(stack.pop()), int(stack.pop())
                if 0 < n <= len(stack):
                    top = stack[-n:]
                    stack[-n:] = top[-(j % n) :] + top[: -(j % n)] if j % n else top
            elif t == "if":
                if stack.pop():
                    go(body[i - 1])
            elif t == "ifelse":
                go(body[i - 2] if stack.pop() else body[i - 1])
            else:
                raise ValueError(t)

    try:
        go(program)
    except (ValueError, IndexError, OverflowError, TypeError, ZeroDivisionError):
        stack = []
    out = [float(v) for v in stack[-outputs:]]
    return [0.0] * (outputs - len(out)) + out
