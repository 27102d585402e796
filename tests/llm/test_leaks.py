"""Values that patterns used to cut, keys in plans, and articles that were taken for comments or forms."""

import re
import time

import pytest

from dealweave.llm import html, pii
from tests.llm.test_operators import brute_text

ARTICLE, REMARKS = "Article text goes on. " * 14, "A reader says so. " * 90
GREEK = "αβγδεζηθικλμνξοπρςστυφχψω"


def rewritten(spark, *texts):
    found = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    found.sort(key=lambda r: r["row"]["doc_id"])
    return [(r["row"]["text"], r["n_found"]) for r in found]


def test_whole_values(spark):
    long_secret, long_name = "aB3" * 100, "abcde" * 16
    found = rewritten(spark, f"token={long_secret} end", f"{long_name}@x.de", "müller@x.de", "AT61 1904 3002 3457 3201 EUR due", f"{GREEK}@x.gr, жук@x.ru", "no mail: a @ b, x@y")
    assert found[0] == (f"token={brute_text(long_secret, 'k', 'secret')} end", 1)
    assert found[1] == (f"{brute_text(long_name, 'k', 'email')}@x.de", 1)
    name = found[2][0].removesuffix("@x.de")
    assert found[2][1] == 1 and len(name) == 6 and re.fullmatch("[a-z][à-öø-ÿ][a-z]{4}", name) and "ller" not in name
    account = found[3][0]
    assert found[3][1] == 1 and account.endswith(" EUR due") and re.match(r"AT\d\d( \d{4}){4} EUR due", account) and "1904 3002" not in account
    bare = account.removesuffix(" EUR due").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert found[4][1] == 2 and GREEK not in found[4][0] and "жук" not in found[4][0] and found[4][0].endswith("@x.ru")
    assert found[5] == ("no mail: a @ b, x@y", 0)


def test_account_numbers_by_country(spark):
    valid = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "ES91 2100 0418 4502 0005 1332"]
    for old, (new, n) in zip(valid, rewritten(spark, *(f"pay {v} TODAY 12" for v in valid)), strict=True):
        got = new.removeprefix("pay ").removesuffix(" TODAY 12")
        bare = got.replace(" ", "")
        assert n == 1 and got != old and got[:2] == old[:2] and re.sub(r"\S", "x", got) == re.sub(r"\S", "x", old), old
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_long_runs_are_read_once(spark):
    texts = ["x." * 400_000 + "@", "a@" + "b." * 400_000, "token=" + "z" * 20_000, "ü" * 300_000]
    start = time.time()
    found = rewritten(spark, *texts)
    assert [len(t) for t, _ in found] == [len(t) for t in texts] and time.time() - start < 120
    assert found[0][1] == found[3][1] == 0 and found[2][1] == 1


def test_key_is_not_in_the_plan(spark):
    key = "very-hidden-key-4711"
    df = pii.pseudonymise(spark.createDataFrame([(1, "a@b.de")], "doc_id long, text string"), key)
    df.collect()
    assert key not in df._jdf.queryExecution().toString() and key not in df._jdf.queryExecution().executedPlan().toString()
    pattern = spark.sparkContext.getConf().get("spark.redaction.regex", "(?i)secret|password|token|access[.]?key")
    assert re.search(pattern, pii.KEY_SETTING)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="post"><p>{ARTICLE}</p></div><div class="comments"><p>{REMARKS}</p></div>',
        f'<article>{ARTICLE}</article><section class="comments"><article>{REMARKS}</article></section>',
        f'<div id="content"><p>{ARTICLE}</p><ol class="commentlist"><li>{REMARKS}</li></ol></div>',
        f'<form action="/"><main><p>{ARTICLE}</p></main><input value="x"></form>',
        f'<form><div><h1></h1><p>{ARTICLE}</p></div><select><option>no</option></select></form>',
        f'<div role="form"><article><p>{ARTICLE}</p></article></div>',
        f'<div aria-hidden="true"><main><p>{ARTICLE}</p></main></div>',
        f'<form><div><p>{ARTICLE}</p><button>send</button></div></form><script>var x</script>',
        f"<nav><ul><li>home</ul><article><p>{ARTICLE}</p></article>",
        f"<nav><a>home</a><main><p>{ARTICLE}</p></main>",
        f'<div class="page comments-open"><main><p>{ARTICLE}</p></main><div class="comments">{REMARKS}</div></div>',
        f'<main><p>{ARTICLE}</p></main><div hidden><article>{REMARKS}</article></div>',
        f"<article><p>{ARTICLE}</p></article><aside><article>{REMARKS}</article></aside>",
    ],
)
def test_articles_stay(page):
    page = f"<html><body>{page}</body></html>"
    want = ARTICLE.strip()
    assert html.extract(page) == want
    votes = html.page_votes(page)
    assert html.extract(page, max(votes, key=lambda v: v[1])[0] if votes else None) == want


def test_comments_alone_give_nothing():
    assert html.extract(f'<body><div class="comments"><p>{REMARKS}</p></div></body>') == ""
    assert html.extract("<body><nav>home</nav><footer>end</footer></body>") == ""
    assert html.extract("<body><form>Name <input> Password <input><button>in</button></form></body>") == ""
