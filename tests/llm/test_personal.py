import pytest

from newsweir.llm.personal import Finder, Recogniser, find_personal, redact_personal, settle
from newsweir.llm.pii_examples import filled, invented_names, wordings

GIVEN = "Edith Kwame Rosa Viggo Sten Lone Mark Hope Basil Karen Storm Freja Silke Hugo Åsa Anne-Liv".split()
FAMILY = [a + b for a in ("Bren", "Cradel", "Tal", "Ulv", "Mossel", "Kvis", "Rav", "Yar", "Holen", "Dal", "Egg", "Pil") for b in ("worth", "mund", "skær", "qvist", "holt", "dahl", "garth", "kamp")]
NAMES = [(n, "given", None) for n in GIVEN] + [(n, "family", None) for n in FAMILY] + [(None, "given", None), ("Edith", "given", "en")]


@pytest.fixture(scope="module")
def model():
    return Recogniser(GIVEN, FAMILY)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "name string, name_kind string, lang string")


def test_wordings_set_aside():
    """Other wordings than those trained on, with other values: a third of all, none of them among the others."""
    trained, held = (set(sum(wordings(h), [])) for h in (False, True))
    assert not trained & held and len(held) > 0.3 * len(trained | held)
    examples = filled(6, seed=77, held=True, neutral=0)
    found = Finder(Recogniser(*invented_names()[2:])).find([t for t, _ in examples])
    hit = sum(len(set(s) & set(f)) for (_, s), f in zip(examples, found))
    assert hit / sum(len(s) for _, s in examples) > 0.85
    assert hit / sum(map(len, found)) > 0.9


def test_training_lowers_loss():
    """A short training on some rounds finds most of what it was shown, and always the same."""
    models = [Recogniser.trained(rounds=1, steps=60) for _ in range(2)]
    assert (models[0].weights == models[1].weights).all()
    examples = filled(1, neutral=0)
    found = Finder(models[0]).find([t for t, _ in examples])
    hit = sum(len(set(s) & set(f)) for (_, s), f in zip(examples, found))
    assert hit > 0.5 * sum(len(s) for _, s in examples)


def test_the_same_among_others(model):
    text = ["Ring me on 020 7946 0123! Photo: Edith Brenworth"]
    assert Finder(model).find(text) == Finder(model).find(text * 3)[:1]


def test_plain_text_stays(model):
    texts = ["Route 14 past Millbrook is shut.", "Invoice 2024-118834 was paid late.", "Mark Dale is a hill above the reservoir.", "We hope for a storm."]
    assert Finder(model).find(texts) == [[], [], [], []]


TEXT = "Yours,\nHugo Mosselkamp\n12b Mill Road\n07700 900123\nWrite to hugo.mosselkamp (at) tarnmail (dot) example. Invoice 2024-118834 was paid late."


def test_find_and_redact(spark, names):
    rows = [(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", "x"), (5, (TEXT + "\n") * 800, "x")]
    df = spark.createDataFrame(rows, "doc long, text string, pii_text string")
    want = {
        ("name", "Hugo Mosselkamp"),
        ("address", "12b Mill Road"),
        ("phone", "07700 900123"),
        ("email", "hugo.mosselkamp (at) tarnmail (dot) example"),
    }
    got = [tuple(r) for r in find_personal(df, "doc", "text", names).collect()]
    assert {r[1:] for r in got if r[0] == 1} == want and {r[0] for r in got} == {1, 5}
    assert {r[1:] for r in got if r[0] == 5} >= want and len(got) == len(set(got))
    clean = {r["doc"]: r["text"] for r in redact_personal(df, "doc", "text", names).collect()}
    assert clean[1] == "Yours,\n[NAME]\n[ADDRESS]\n[PHONE]\nWrite to [EMAIL]. Invoice 2024-118834 was paid late."
    assert clean[2] is None and clean[3] == "" and clean[4] == "nothing here"
    assert find_personal(df.limit(0), "doc", "text", names).count() == 0


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("Mail: mailto:a.b@c.example.", "email", "a.b@c.example"),
        ("<a@b.test>", "email", "a@b.test"),
        ("Questions? a at b dot example dot org", "email", "a at b dot example dot org"),
        ("no address", "email", None),
        ("(+45) 1234 5678!", "phone", "(+45) 1234 5678"),
        ("1234 56", "phone", None),
        ("666-12-1234.", "idnumber", "666-12-1234"),
        ("near 12 Mill Road", "address", "12 Mill Road"),
        ("Moorweg nr. 4.", "address", "Moorweg nr. 4"),
        ("Mrs Edith Brenworth,", "name", "Edith Brenworth"),
        ("In Saltwick", "name", None),
        ("Edith", "name", None),
        ("Brenworth, E.", "name", "Brenworth, E."),
        ("I heard", "name", None),
        ("i. brenworth", "name", "i. brenworth"),
    ],
)
def test_settling(text, kind, want):
    got = settle(text, 0, len(text), kind)
    assert (text[got[0] : got[1]] if got else None) == want
