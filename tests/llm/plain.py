"""Plain versions of the stages, for the tests: no Spark, every pair compared."""

import math
import re
from collections import Counter

import xxhash

from quern.llm import decontamination, language, secrets

ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def bits_of(model, text):
    """The least bits a symbol and their language; symbols."""
    every, n = all_bits(model, text)
    return min(zip(every, model.names, strict=True), key=lambda x: x[0]), n


def all_bits(model, text):
    """Bits a symbol by language, by longest matches found as substrings; symbols."""
    code = model.code(text.lower()).tolist()
    out = []
    for own, bits in zip(model.sources, model.bits, strict=True):
        phrases, now = int(bool(code)), ""
        for c in code:
            known = c < language.OTHER and chr(c + 1) in own
            if known and now + chr(c + 1) in own:
                now += chr(c + 1)
            else:
                phrases, now = phrases + 1, chr(c + 1) if known else ""
        out.append(phrases * bits / max(1, len(code)))
    return out, len(code)


def model_of(texts):
    model = language.Model(texts)
    model.codes[0] = language.BREAK
    model.sources = ["".join(chr(c + 1) for c in model.code(texts[n]).tolist()) for n in model.names]
    model.codes[0] = language.SPACE
    return model


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fp):
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if root[a] != root[b] and (fp[a] ^ fp[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def leaks(text, item):
    d, b = words(text), words(item)
    mask = lambda w: decontamination.MASKS[xxhash.xxh64_intdigest(w, 42) & 1]
    span = decontamination.SPAN
    for i in range(len(d) - span + 1):
        m = mask(d[i])
        for j in range(len(b) - span + 1):
            if all(d[i + o] == b[j + o] for o in m):
                back = min(i, j, decontamination.AROUND)
                n = min(back + span + decontamination.AROUND, len(d) - i + back, len(b) - j + back)
                same = sum(d[i - back + k] == b[j - back + k] for k in range(n))
                if same >= decontamination.LEAST_WORDS and same / n >= decontamination.LEAST_SHARE:
                    return True
    return False


def base_spans(text):
    a = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    b = [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return a + b + c


def dense_spans(text):
    out = []
    for pattern, least in secrets.CLASSES:
        for m in re.finditer(pattern, text):
            if re.search(secrets.ALLOWED, m[0]):
                continue
            at = [k for k in range(len(m[0]) - secrets.WINDOW + 1) if -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in Counter(m[0][k : k + secrets.WINDOW]).values()) >= least]
            if at:
                out.append(("entropy", m.start() + at[0], m.start() + at[-1] + secrets.WINDOW))
    return out


def spans(text):
    return sorted(set(base_spans(text) + dense_spans(text)), key=lambda v: (v[1], secrets.KINDS.index(v[0]), v[2]))


def masked(text):
    out, at = "", 0
    for _, s, e in spans(text):
        if s >= at:
            out += text[at:s] + "<secret>"
        at = max(at, e)
    return out + text[at:]
