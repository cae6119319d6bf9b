"""Secrets in runs that cross the windows of a compressed layer."""

import base64
import gzip
import random

import pytest

from graphloom.llm import secret_scan
from graphloom.llm.secret_scan import find_secrets

RNG = random.Random(6)
WORDS = " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(450_000))


def packed(text: str) -> str:
    return base64.b64encode(gzip.compress(text.encode(), 1)).decode()


@pytest.mark.parametrize("at", [100_000, 900_000, 1_020_000, 1_400_000])
@pytest.mark.parametrize("wrap", [0, 76])
def test_long_runs_over_a_window(at, wrap):
    inner = base64.b64encode((WORDS[:320_000] + " password = hunter2hunter " + WORDS[:320_000]).encode()).decode()
    if wrap:
        inner = "\n".join(inner[k : k + wrap] for k in range(0, len(inner), wrap))
    text = f"blob: {packed(WORDS[:at] + ' data ' + inner + ' ' + WORDS[at : at + 1_200_000])} end"
    assert any(k == 0 for _, _, k in find_secrets(text)[1])


def test_matches_longer_than_the_overlap(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 256)
    for at in (0, 3000, 3900, 4090, 4200):
        for secret, kind in ((f"token = {'x' * 9000}", 0), ("0123456789abcdef" * 700, 2), (f"password ={' ' * 5000}hunter2", 0), ("%70assword%3dhunter2", 0), ("AKIA" + "Z" * 6000, 1)):
            got = find_secrets(f"x {packed(WORDS[:at] + ' ' + secret + ' ' + WORDS[:9000])} y")[1]
            assert kind in {k for _, _, k in got}, (at, secret[:10])


def test_further_escapes_and_wide_text():
    for x in ("\\u{70}assword = hunter2", "\\U00000070assword = hunter2", "password&equals;hunter2", "password &colon; &quot;hunter2&quot;"):
        base, every, _ = find_secrets(f"see {x} here")
        assert not base and [k for _, _, k in every] == [0], x
    for encoding in ("utf-16-le", "utf-16-be"):
        run = base64.b64encode("password = hunter2 of mine".encode(encoding)).decode()
        text = f"cmd {run} x"
        (a, b, k), = find_secrets(text)[1]
        assert k == 0 and 4 <= a < b <= 4 + len(run)


def test_a_run_beyond_the_longest_is_taken_in_parts(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 256)
    monkeypatch.setattr(secret_scan, "RUN_MOST", 1 << 14)
    inner = base64.b64encode((WORDS[:30_000] + " password = hunter2hunter " + WORDS[:30_000]).encode()).decode()
    assert any(k == 0 for _, _, k in find_secrets(f"x {packed('a ' + inner)} y")[1])
