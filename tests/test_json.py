"""The search for JSON in texts: awkward braces, and time linear in the text."""

import json
import random
import re
import time

from quarry.operators.documents import DEEPEST, first_json

MARK = re.compile(r'\\.|["{}]', re.S)


def brute(text):
    """Every brace in turn, read from there on."""
    for start in (m.start() for m in re.finditer("{", text)):
        depth = odd = 0
        for m in MARK.finditer(text, start):
            odd ^= m[0] == '"'
            depth += (not odd) * ((m[0] == "{") - (m[0] == "}"))
            if not depth:
                try:
                    got = json.loads(text[start : m.end()])
                except ValueError:
                    break
                if isinstance(got, dict) and got:
                    return json.dumps(got)
                break
    return None


def test_random_texts():
    rng = random.Random(8)
    pieces = ["{", "}", '"', "\\", '"a":', "1", ",", " ", '{"b":2}', "\\{", "[", "]", "{}", "x"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 18)))
        assert first_json(t) == brute(t), t


def test_time_is_linear():
    began = time.time()
    for t in ("\\{" * 50_000, '{"a":' * 20_000 + "oops" + "}" * 20_000, "{" * 50_000 + "}" * 50_000, '{"a":1,' * 20_000 + "}" * 20_000):
        assert first_json(t) is None
    assert first_json('{"a":' * 20_000 + "}" * 20_000 + ' {"k": 1}') == '{"k": 1}'
    assert len(first_json('{"a":' * 30_000 + "1" + "}" * 30_000)) > DEEPEST  # the inner ones
    assert time.time() - began < 20


def test_nothing():
    assert first_json(None) is None and first_json("") is None and first_json("{}") is None
