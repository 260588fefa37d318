from vacantia.llm import boilerplate as B
from vacantia.llm import boilerplate_train as BT
from vacantia.llm import layout as L
from vacantia.llm import residue as R

PAGE = """Home > Jobs > Data Engineer
Jobs | Sign in | Help
We use cookies to improve your experience.
Accept all

Data Engineer
Location: Pelagia
You will build our cookie consent and privacy policy tooling in Go.
Requirements
- Experience in a mobile team
Follow us
• 5+ years with Go
Acme is an equal-opportunity employer.
Similar jobs
QA Engineer – Pamovat
Data Analyst
Privacy policy · Sitemap
© 2024 Acme. All rights reserved."""


def test_lines_of_a_page():
    assert B.outside(PAGE) == [1, 2, 3, 4, 11, 14, 15, 16, 17, 18]


def test_languages_and_decoys():
    assert all(map(BT.furniture, ["Nous utilisons des cookies pour mesurer les visites.", "Acme nutzt Cookies, um Besuche zu messen.", "Acme and its partners store cookies.", "Saved searches > Help > About us", "Powered by Acme"]))
    assert not any(map(BT.furniture, ["You own the navigation menu and footer of the public site, written in Go.", "Part of the work is the newsletter sign-up flow, which runs on Java.", "Data Engineer", "Your profile"]))


HTML = """<html><head><title>x</title><style>p{}</style></head><body><script>var a=1</script><h1>Role</h1><p>One <b>bold</b>
line<p>Two<br>three<div style="display: none">hidden</div><ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol>
<table><tr><td>Pay<td>10<tr><td>Longer name<td>2000</table><span hidden>no</span><p aria-hidden="true">no</p>&amp; end <unknown role>"""


def test_rendering():
    assert L.render(HTML) == "Role\n\nOne bold line\n\nTwo\nthree\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\nPay          10\nLonger name  2000\n\n& end <unknown role>"
    assert L.render("plain\n\ntext & more\n") == "plain\n\ntext & more\n"
    assert L.render("</p></x><td>a<li>b") == "</x>\na\n- b"


GOOD = "Data Engineer\nYou know how ${variable} substitution works in shell scripts.\nYou keep null and undefined values out of our TypeScript code.\nYou replace lorem ipsum texts in our design system with real copy."
BAD = ["Our office in {{company_name}} is close to the station.", "Reports to: [INSERT ROLE]", "Start date: <<city>>", "Join <insert city here> and help us grow.", "Acme is down for maintenance. We will be back at 2:00.", "502 Bad Gateway", "Sorry, Acme does not work without JavaScript enabled.", "[object Object]", "undefined", "Sit rutrum amet pretium lorem ipsum dolor turpis nulla felis.", "xxx xxx xxx xxx", "The salary for this role is @@SALARY_RANGE@@.", "Start date: *|startDate|*", "Every Monday the team meets. [COMPANY_NAME TBC BY HR]", "Join @@job.title@@ and help us grow."]


def test_tables(spark):
    rows = [(1, "Data Engineer", GOOD, 0), (2, None, None, 0), (3, "${title} - Careers", "Data Engineer", 0), (4, "Data Engineer", "", 0), (5, "JavaScript Developer, Error Pages | Acme", GOOD, 0), (6, None, PAGE, 0), (6, None, PAGE, 0), (7, "  ", "\n\n", 0)]
    rows += [(100 + k, "Data Engineer", f"Data Engineer\nWe keep devices connected.\n{b}", 0) for k, b in enumerate(BAD)] + [(900, "x", "we keep devices " * 20_000, 0)]
    details = spark.createDataFrame(rows, "job_id bigint, page_title string, description_text string, line_no int")
    bad = R.found(details)
    assert {r.job_id for r in bad.collect()} == {3, *range(100, 100 + len(BAD))}
    got = {tuple(r) for r in B.found(details, R.marker(details)).collect()}
    assert {n for j, n in got if j == 6} == set(B.outside(PAGE)) and {j for j, _ in got} == {6}
    assert R.found(details.limit(0)).count() == 0 and B.found(details.limit(0), R.marker(details.limit(0))).count() == 0
    assert details.select(L.rendered("description_text").alias("t"), B.main_body({})("description_text").alias("m")).count() == len(rows)


def test_weights_count_the_tokens_that_are_judged(spark):
    details = spark.createDataFrame([(1, "Join {{team}} 2024", "from 10 to 20\n\nplain line"), (2, None, "${a} and [INSERT ROLE]\nError 404")], "job_id bigint, page_title string, description_text string")
    idf, other = R.idf_table(details)
    weight = lambda n: R.math.log(6 / (n + 1)) + 1
    assert [idf[t] for t in (R.SLOT, "0", "404", "error", "lorem")] == [weight(n) for n in (2, 2, 1, 1, 0)] and other == R.math.log(6) / 2 + 1


def test_frame_and_links_of_markup():
    page = "<nav><a href=/>Home</a><a href=/jobs>Zorbel</a></nav><main><h1>Data Engineer</h1><p>You <a href=x>build</a> tools for planning.</p></main><footer>Vintrel</footer>"
    lines, frame = L.render_blocks(page)
    assert {x: f for (_, x), f in zip(lines, frame) if x} == {"HomeZorbel": True, "Data Engineer": False, "You build tools for planning.": False, "Vintrel": True}
    assert L.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_frequencies_and_long_lines():
    [c] = B.line_counts([["a", "b", "a"], ["a"], []])
    assert {k: (n, t, b) for k, n, t, b in c.itertuples(index=False)} == {B.line_number("a"): (2, 0.0, 2.0), B.line_number("b"): (1, 1.0, 1.0)}
    assert B.frequent([(5, 2, 0.0, 2.0), (6, 1, 1.0, 1.0)], 2).keys() == {5}
    lines = PAGE.split("\n")
    assert B.outside("\n".join([*lines[:8], "You will plan routes for our customers. " * 20_000, *lines[8:]])) == [n + (n > 8) for n in B.outside(PAGE)]
    long = "© 2024 Acme Harbor Holdings International Limited, Port Alma, and all companies of its group in Pelagia and Norvania. All rights reserved."
    assert len(long) > 120 and B.outside(PAGE + "\n" + long)[-1] == PAGE.count("\n") + 2


def test_passages_over_two_lines_and_of_one_word():
    judge = R.Judge({t: 5.0 for t in R.VOCABULARY}, 5.0)
    assert judge.page(None, "The page you are looking\ncould not be found.") and not judge.page(None, "The page you are looking\nis about soil.")
    assert judge.page(None, "zork zork zork zork") and not judge.page(None, "1 2 3 4") and not judge.page(None, "zork zork zork")
