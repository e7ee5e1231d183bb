import random

import pytest

from polyglint.functions import placeholders as P


@pytest.mark.parametrize(
    "text,want",
    [
        ("%d of %s", ["%1$d", "%2$s"]),
        ("100%% of %2$@ and 25% off", ["%2$@"]),
        ("%(n)s %(m)d", ["%(n)s", "%(m)d"]),
        ("{{ a }} {b} {0}", ["{{a}}", "{b}", "{0}"]),
        ("{n, plural, one {# {x}} other {%d}}", ["{n}", "{n}/plural", "{x}", "%1$d"]),
        ("{n, plural, one {x}}", ["{n}", "{n}/plural", P.MALFORMED]),
        ("$t(k) $name $5 $", ["$t(k)", "$name"]),
        ("%#@files@ %arg", ["%#@…@", "%arg"]),
        ("{ open", []),
    ],
)
def test_extract(text, want):
    assert [p.canonical for p in P.extract(text)] == want


@pytest.mark.parametrize("s,t,clean", [("%1$s %2$s", "%2$s %1$s %1$s", True), ("%s %d", "%d %s", False), ("{a}", "{a}{a}", False), ("%(a)s", "%(a)s %(a)s", True), ("plain", "auch", True)])
def test_compare(s, t, clean):
    assert (P.compare(s, t) is None) == clean


def test_names_that_were_translated_are_put_back():
    assert P.repair("see {{ models }}", "vedi {{ modelli }}") == "vedi {{ models }}"
    assert P.repair("{a} {b}", "{x}") is None


def test_counts_may_be_left_out_of_exact_forms():
    assert P.compare_forms("de", "one", "%d files", "eine Datei") is None
    assert P.compare_forms("ru", "one", "%d files", "файл") is not None


def test_plurals():
    assert P.icu_plurals("{n, plural, one {a} other {{m, plural, other {x}}}}") == [("n", ["one", "other"]), ("m", ["other"])]
    assert P.missing_categories("pl", ["one", "other"]) == ["few", "many"]
    assert P.missing_categories("ar", ["other", "=0"]) == []


def test_pseudo_keeps_what_is_not_text():
    assert P.pseudo("Hi %d <b>{x}</b> &amp;") == "[Ĥí %d <b>{x}</b> &amp; ~]"
    assert P.compare("Hi %d {x}", P.pseudo("Hi %d {x}")) is None


def test_every_mutation_is_caught_and_no_identity_is():
    r = random.Random(1)
    tokens = ["%1$s", "%d", "{{count}}", "{name}", "%(n)s", "$t(key)"]
    for _ in range(300):
        parts = r.sample(tokens, r.randint(1, 3))
        text = " word ".join(parts)
        assert P.compare(text, "xx " + text) is None
        gone = r.choice(parts)
        assert P.compare(text, text.replace(gone, "", 1)) is not None
        assert P.compare(text, text + " {extra}") is not None


def test_open_braces_take_linear_time():
    import time

    from polyglint.functions import placeholders as H

    began = time.time()
    for text in ("{" * (1 << 20), "{ " * (1 << 19), "{a" * (1 << 19), "{a}" * (1 << 18)):
        H.prose(text)
        H.extract(text)
    assert time.time() - began < 20
    assert [p.canonical for p in H.extract("{a} {{b}} {c {d")] == ["{a}", "{{b}}"] and H.prose("a {b {c}} d {e") == "a  d {e"
