import hashlib
import math
import random
import re
from collections import Counter

from spindrift.llm import secrets

HEX40 = "59ea3612aa6fdb1d4556ccac234e5419878f26bc"


def base(text):
    """The contract's three patterns, taken literally."""
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group()) >= n]
    return sorted(out)


def test_base_spans_are_the_literal_patterns():
    rng = random.Random(1)
    bits = ["token", "Secret", "API_KEY", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234567890", HEX40, "abc", "é", "f" * 23, "f" * 24, "x.y-z", "\n", "AKIAAKIA", "ſecret", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        found, more = secrets.spans_of(text.encode())
        assert found == base(text), text
        assert all(not (s < e2 and s2 < e) for s, _, e in found for s2, _, e2 in more)


def test_entropy_is_that_of_each_window():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcdef0123456789ABZzq+/_") for _ in range(rng.randint(0, 60)))
        want = set()
        for i in range(len(text) - secrets.WINDOW + 1):
            w = text[i : i + secrets.WINDOW]
            bits = -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
            letters, digits = sum(c.isalpha() for c in w), sum(c.isdigit() for c in w)
            kind = secrets.window_class(sum(c.islower() for c in w), sum(c.isupper() for c in w), len(w) - letters - digits, sum(c.lower() > "f" for c in w if c.isalpha()))
            if digits >= 3 and letters >= 3 and bits >= secrets.THRESHOLDS[kind] - 1e-12:
                want |= set(range(i, i + secrets.WINDOW))
        got = {p for a, b in secrets.entropy_spans(text) for p in range(a, b)}
        assert got == want


def test_added_spans_and_allow_list():
    random_looking = "q7Zt0Xw3Lk9Pd2Vb6Nm1Rs8Y"
    assert secrets.spans_of(f"see {random_looking} there".encode())[1]
    for harmless in ("thisisaverylongwordwithoutanydigitsatall", "123e4567-e89b-12d3-a456-426614174000", "1234567890123456789012", f"EXAMPLE{random_looking}"):
        assert secrets.spans_of(f"see {harmless} there".encode()) == ([], [])


def test_scan_of_odd_rows(documents, odd_rows):
    rows = [*odd_rows, (20, f'x token = "{HEX40}" y', "en", "a")]
    got = secrets.scan(documents(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base(r[1] or ""))) for r in rows)
    digest = Counter((r["doc_id"], r["base_sha256"]) for r in got)
    assert digest == Counter({(i, hashlib.sha256(s.encode()).hexdigest()): n for (i, s), n in want.items()})
    hit = next(r for r in got if r["doc_id"] == 20)
    assert (hit["n_assign"], hit["n_access"], hit["n_hex"]) == (1, 0, 1) and hit["spans"] == "assign:2:51,hex:11:51"
    assert secrets.scan(documents([])).count() == 0


def test_redact_masks_only_secrets(documents, odd_rows):
    rows = [*odd_rows, (20, f'x token = "{HEX40}" y', "en", "a")]
    docs = documents(rows)
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter((i, t) for i, t, *_ in odd_rows) + Counter([(20, 'x [secret]" y')])


def test_tokens_with_few_digits_are_found_whole():
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for alphabet in (letters, letters + "0123456789"):
        for n in (20, 24, 32, 40):
            tokens = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
            whole = sum(secrets.spans_of(f"see {t} there".encode()) == ([], [(4, 3, 4 + n)]) for t in tokens)
            assert whole >= 0.97 * len(tokens), (alphabet, n)
    token = "q7Zt0Xw3Lk9Pd2Vb6Nm1Rs8Y"
    at = len("docs/example/")
    assert secrets.spans_of(f"docs/example/{token}".encode())[1] == [(at - 1, 3, at + len(token))]
    mixed = f"{token}_{HEX40}_{token}"
    assert secrets.spans_of(mixed.encode())[1] == [(0, 3, 25), (65, 3, len(mixed))]


def test_a_long_text_of_secrets_takes_linear_time():
    import time

    text = " ".join(f"password=abc{i}def token: qW3rT5yU7iO9pA1sD3fG{i}" for i in range(8000))
    began = time.process_time()
    base, _ = secrets.spans_of(text.encode())
    assert len(base) == 16_000 and time.process_time() - began < 4
