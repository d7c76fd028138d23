"""Names, addresses and numbers that their form and the lists make sure, where nothing around them speaks for them."""

import pytest

from newsweir.llm.personal import Finder, Recogniser, settle

GIVEN = "Edith Kwame Rosa Viggo Sten Hugo Åsa Anne-Liv".split()
FAMILY = [a + b for a in ("Bren", "Cradel", "Tal", "Ulv", "Mossel", "Kvis", "Rav", "Yar") for b in ("worth", "mund", "skær", "qvist", "holt", "dahl", "garth", "kamp") if a + b != "Ulvkamp"]


@pytest.fixture(scope="module")
def finder():
    return Finder(Recogniser(GIVEN, FAMILY))


@pytest.mark.parametrize(
    "value, kind",
    [
        ("Edith Brenworth", "name"),
        ("rosa ulvkamp", "name"),
        ("Talqvist, Viggo", "name"),
        ("Sten R. Mosselholt", "name"),
        ("Hugo Åsa Ravgarth", "name"),
        ("Rosa Kvisdahl-Yarholt", "name"),
        ("Quibby Ulvkamp", "name"),
        ("Kornblomstvænget 12", "address"),
        ("Gl. Pileallé nr. 7", "address"),
        ("14 Thistle Rise", "address"),
        ("23456781", "phone"),
    ],
)
@pytest.mark.parametrize("text", ["the harbour {} stone winter", "{}", "gravel\n{}\nlantern basket"])
def test_form_alone(finder, value, kind, text):
    t = text.format(value)
    at = t.index(value)
    assert finder.find([t])[0] == [(at, at + len(value), kind)]


@pytest.mark.parametrize("text", ["Landstraße 14 ist gesperrt.", "order no. 23456781 was late", "Mrs Brenworth sold it", "By Brenworth", "Solvejen 12.5 km"])
def test_forms_of_other_things(finder, text):
    assert finder.find([text]) == [[]]


@pytest.mark.parametrize(
    "text, found, kind, want",
    [
        ("Write to a.b@c.example. Edith knows", "a.b@c.example. Edith", "email", "a.b@c.example"),
        ("to anna.b@c.example", "b@c.example", "email", "anna.b@c.example"),
        ("a@mail.c.example", "a@mail", "email", "a@mail.c.example"),
        ("a at mail dot c dot example", "a at mail dot c", "email", "a at mail dot c dot example"),
        ("on 2345678 901 today", "2345678", "phone", "2345678 901"),
        ("on +46(0)8.123.456.78 now", "8.123.456.78", "phone", "+46(0)8.123.456.78"),
        ("7\n555.123.4567", "123.4567", "phone", "555.123.4567"),
        ("card 666-12-3456", "666-12-3456", "phone", "666-12-3456"),
        ("at Mosevej 12, 2. tv", "Mosevej 12, 2", "address", "Mosevej 12"),
        ("at Lille Mosevej 12", "Mosevej 12", "address", "Lille Mosevej 12"),
        ("Edith Brenworth, 45", "Edith Brenworth, 45", "name", "Edith Brenworth"),
    ],
)
def test_whole_spans(text, found, kind, want):
    a = text.index(found)
    got = settle(text, a, a + len(found), kind)
    assert got and text[got[0] : got[1]] == want
    assert got[2] == ("idnumber" if want.startswith("666") else kind)


def test_texts_stay_apart(finder):
    assert finder.find(["basket Edith", "Brenworth lantern"]) == [[], []]
