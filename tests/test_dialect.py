import pytest

from planloom.dialect import ParseError, parse, parse_expression

#: For each production of the grammar a text that uses it to the full.
GOOD = [
    "SELECT DISTINCT price, price * 2 AS twice FROM sales",
    "select s.*, q.n from sales as s, (select count(id) as n from sales) as q, series(1, 2 + 3) as r",
    "SELECT id FROM sales WHERE price between 2 AND 9 and shop in ('north', 'west') and not(paid)",
    "SELECT id FROM sales WHERE (price > 2 and paid) or shop like '_est%'",
    "SELECT shop, sum(price) FROM sales GROUP BY shop, day + 1 HAVING sum(price) > 4 ORDER BY sum(price) desc, shop ASC",
    "SELECT `unit`, [shop.name], \"it's\", 'say \\'so\\'' FROM sales LIMIT 2 * 5 OFFSET +1",
    "SELECT .25, 12.5, true, FALSE, DATE '2024-02-29', -(-id) FROM sales",
]
#: For each production a text that leaves out, doubles or misplaces one of its parts.
BAD = [
    " ",
    "FROM sales",
    "SELECT FROM sales",
    "SELECT id, FROM sales",
    "SELECT id price FROM sales",
    "SELECT id AS FROM sales",
    "SELECT DISTINCT DISTINCT id FROM sales",
    "sElEcT id FROM sales",
    "SELECT id FROM",
    "SELECT id FROM sales s",
    "SELECT id FROM sales,",
    "SELECT id FROM (SELECT id FROM sales",
    "SELECT id FROM sales WHERE",
    "SELECT id FROM sales WHERE price >",
    "SELECT id FROM sales WHERE price between 3",
    "SELECT id FROM sales WHERE shop in ()",
    "SELECT id FROM sales WHERE shop in (SELECT shop FROM sales)",
    "SELECT id FROM sales WHERE shop like",
    "SELECT id FROM sales WHERE not",
    "SELECT id FROM sales GROUP shop",
    "SELECT id FROM sales GROUP BY",
    "SELECT id FROM sales HAVING",
    "SELECT id FROM sales ORDER id",
    "SELECT id FROM sales ORDER BY id down",
    "SELECT id FROM sales ORDER BY id desc desc",
    "SELECT id FROM sales LIMIT",
    "SELECT id FROM sales LIMIT 3, 4",
    "SELECT id FROM sales LIMIT 3 OFFSET",
    "SELECT id FROM sales OFFSET 3",
    "SELECT id FROM sales WHERE paid GROUP BY shop WHERE paid",
    "SELECT id FROM sales EXCEPT SELECT id FROM sales",
    "SELECT 3x",
    "SELECT (2, 3) + 4",
    "SELECT 'open",
    "SELECT DATE '2023-02-29'",
    "SELECT sum(price",
    "SELECT id; SELECT id",
]


@pytest.mark.parametrize("text", GOOD)
def test_parses(text):
    parse(text)


@pytest.mark.parametrize("text", BAD)
def test_refuses(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize(
    "text,shown",
    [
        ("1 - 2 - 3", "(1 - (2 - 3))"),
        ("a * b + c", "(a * (b + c))"),
        ("-1 = 1", "-((1 = 1))"),
        ("a = b or c = d", "(a = (b or (c = d)))"),
        ("a == 1 and b != 2", "((a = 1) and (b <> 2))"),
        ("x between lo and hi", "(x between lo and hi)"),
    ],
)
def test_right_associative(text, shown):
    assert str(parse_expression(text)) == shown
