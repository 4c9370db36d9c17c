"""Random keys of any alphabet and length, keys that stand twice, and words that are none."""

import random
import string
import time

import pytest

from shardlens.llm import secrets

PROSE = "We keep a note of what is to be done here, and of who does it. The bearer {} is used for this, as was said before. "
KINDS = {"HEX": "0123456789ABCDEF", "base62": string.ascii_letters + string.digits, "letters": string.ascii_letters, "lower": string.ascii_lowercase}


@pytest.mark.parametrize("kind,length", [("HEX", 40), ("HEX", 64), ("HEX", 128), ("base62", 24), ("base62", 2000), ("letters", 40), ("lower", 40), ("letters", 500)])
def test_random_keys_are_reported(kind, length):
    rng, told, n = random.Random(length), 0, 100
    for _ in range(n):
        key = "".join(rng.choices(KINDS[kind], k=length))
        text = PROSE.format(key) + PROSE.format("thing")
        told += [text[s:e] for s, k, e in secrets.spans_of(text) if k == "novel"] == [key]
    assert told >= 0.95 * n


def test_a_key_that_stands_twice_is_blanked_twice():
    key = "ghp4Zq9Xw27LmT0RkV8sYd3Nc"
    text = PROSE.format(key) * 2
    assert [text[s:e] for s, _, e in secrets.spans_of(text)] == [key, key] and key not in secrets.redacted(text)


def test_many_spans_in_one_text_take_no_longer_each():
    """The base spans are passed once: 32,000 of them in one text, and the spans are those of a check against all."""
    text = " ".join(f"token=abc{k:06d} bearer ghp{k:04d}Zq9Xw27LmT0RkV8sYd" if k % 500 == 0 else f"token=abc{k:06d}" for k in range(32_000))
    began = time.process_time()
    spans = secrets.spans_of(text)
    assert time.process_time() - began < 20
    base = [(s, e) for s, k, e in spans if k != "novel"]
    told = [text[s:e] for s, k, e in spans if k == "novel"]
    assert len(base) == 32_000 and told == [f"ghp{k:04d}Zq9Xw27LmT0RkV8sYd" for k in range(0, 32_000, 500)]


def test_words_and_names_are_not_reported():
    words = "authenticationFailed getAuthorizationProvider access-control-allow administrators responsibilities straightforward recommendation ACCOUNT_SETTINGS_PAGE /usr/local/share/config Benutzerverwaltung renseignements".split()
    told = [w for w in words if secrets.spans_of(PROSE.format(w))]
    assert told == []
