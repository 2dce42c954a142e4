import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from fleetframe.llm import spans

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def digits(text):
    return re.sub("[^0-9]", "", text)


def passes_luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number[::-1])) % 10 == 0


def plain_pii(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [
        ("card", *m.span())
        for m in CARD.finditer(text)
        if 12 <= len(digits(m[0])) <= 19 and passes_luhn(digits(m[0]))
    ]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], spans.PII_KINDS.index(s[0])))


def plain_secrets(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], spans.SECRET_KINDS.index(s[0])))


PARTS = ["a@b.c", "@", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "x", "4111111111111111", "٣", "é", "+1 "]
SECRET_PARTS = ["password", "Token", "api_key", "ſecret", "=", ":", " ", "'", '"', "abc123", "AKIA", "ABCD1234", "deadbeef", "zz"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_personal_data_as_the_plain_patterns(text):
    assert spans.base_pii(text) == plain_pii(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=30).map("".join))
def test_secrets_as_the_plain_patterns(text):
    assert spans.base_secrets(text) == plain_secrets(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a@" * 100_000, "+1 " * 70_000, "1." * 100_000, "f" * 200_000, "password " * 20_000):
        spans.base_pii(text)
        spans.base_secrets(text)


def test_written_form_and_redaction():
    found = [("email", 0, 3), ("card", 2, 6), ("ip", 8, 9)]
    assert spans.written(found) == "email:0:3,card:2:6,ip:8:9"
    assert spans.digest([]) == hashlib.sha256(b"").hexdigest()
    assert spans.redacted("0123456789", found) == "[EMAIL]67[IP]9"


def test_taken_ranges_against_all_pairs():
    rng = random.Random(6)
    for _ in range(300):
        made = lambda: [("hex", a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(9)))]  # noqa: B023, E731
        base, more = made(), [(rng.random(), s) for s in made()]
        taken = spans.Taken(base)
        for _, s in more:
            assert taken.is_free(s) == all(s[2] <= b[1] or s[1] >= b[2] for b in base)
        kept = list(base)
        for _, s in sorted(more, key=lambda x: (-x[0], x[1][1], -x[1][2])):
            if all(s[2] <= b[1] or s[1] >= b[2] for b in kept):
                kept.append(s)
        assert spans.without_overlap(base, more, spans.SECRET_KINDS) == spans.in_order(kept, spans.SECRET_KINDS)
