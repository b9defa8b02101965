import pytest

from shelfscan.plans.query import Clock, Range, byte_count, extensions, is_path, parse, seconds, size_range

NOW = 1772500000.0
CLOCK = Clock(NOW, "UTC")
DAY = 86400.0


def spec(text):
    return parse(text, CLOCK)


def test_names_and_negation():
    s = spec('report "two words" !draft file:')
    assert (s.name, s.name_not, s.kind) == (["report", "two words"], ["draft"], "file")
    assert spec("folder:2020").name == ["2020"] and spec("folder:2020").kind == "folder"
    assert spec("!folder:").kind == "folder"
    assert spec(None) == spec("   ") == spec("! !") == parse("", CLOCK)


def test_content_and_paths():
    s = spec(r'content:"a b" !content:c C: /srv ~ \\nas\x path:"D:\My Docs" !C:\Windows')
    assert s.content == ['"a b"'] and s.content_not == ["c"]
    assert s.paths == ["C:", "/srv", "~", "\\\\nas\\x", "D:\\My Docs"] and s.paths_not == ["C:\\Windows"]
    assert not is_path("1:") and not is_path("ab:") and is_path("d:/x")


def test_extensions():
    assert extensions(" .PDF;docx, ;.x") == [".pdf", ".docx", ".x"]
    assert spec("!ext:tmp ext:a;b").exts_not == [".tmp"]


@pytest.mark.parametrize("text, lo, hi", [("2020", 1577836800, 1609459200), ("2020-03", 1583020800, 1585699200), ("2020-03-15", 1584230400, 1584316800), ("15/03/2020", 1584230400, 1584316800), ("15.3.2020", 1584230400, 1584316800), ("03/2020", 1583020800, 1585699200), ("2020-00", 1577836800, 1609459200), ("2020-03-00", 1583020800, 1585699200)])
def test_periods(text, lo, hi):
    assert CLOCK.period(text) == (lo, hi)


@pytest.mark.parametrize("text", ["20", "2020-13", "2020-02-30", "30/02/2020", "x", "", "2020-1-", "0000"])
def test_no_periods(text):
    assert CLOCK.period(text) is None


def test_days_of_now():
    today = NOW - NOW % DAY
    assert CLOCK.period("today") == (today, today + DAY) and CLOCK.period("Yesterday") == (today - DAY, today)
    assert Clock(NOW, "Asia/Tokyo").period("2020")[0] == 1577836800 - 9 * 3600


def test_ages_and_sizes():
    assert seconds("15m") == 900 and seconds("1.5mo") == pytest.approx(1.5 * 30.44 * DAY) and seconds("3y") == 3 * 365.25 * DAY and seconds("3") is None and seconds("3q") is None
    assert byte_count("1.5kb") == 1536 and byte_count("2 T") == 2 << 40 and byte_count("x") is None
    assert size_range(">5") == Range(5, None) == size_range("5") == size_range(">=5")
    assert size_range("<=5") == Range(None, 6) and size_range("=5") == Range(5, 6) and size_range("<1kb") == Range(None, 1024)
    assert size_range("1..2") == Range(1, 2) and size_range("1..") is None and size_range("") is None


def test_when():
    assert CLOCK.when("older", "1d") == Range(None, NOW - DAY) and CLOCK.when("newer", "1d") == Range(NOW - DAY, None)
    assert CLOCK.when("before", "2018..2020") is None and CLOCK.when("dm", "2018..2019").hi == 1577836800
    assert spec("!before:2020").when == [Range(None, 1577836800, True)]
    assert spec("before:20 size:> older:").when == [] and spec("size:>").sizes == []
