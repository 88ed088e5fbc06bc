import pytest

from gristdex.llm.textforms import plain


@pytest.mark.parametrize(
    "text, kept",
    [
        ("Go away <you worthless fucking idiot> now", "worthless fucking idiot"),
        ("[moron] you", "moron"),
        ("&lt;you are scum&gt;", "you are scum"),
        ('<a title="you stupid bitch">here</a>', "you stupid bitch"),
        ("[quote=dirty whore]hello[/quote]", "dirty whore"),
        ("<i hate you, scum>", "i hate you, scum"),
        ("<font color=" + "x" * 200 + " title='vermin'>", "vermin"),
    ],
)
def test_text_inside_markup_is_kept(text, kept):
    assert kept in plain(text)


def test_words_cut_by_tags_are_whole():
    assert plain("id<font color=red>iot</font> and sc[url=http://a.example]um[/url]").splitlines() == ["idiot and scum", "color=red", "http://a.example"]
    assert plain("<blockquote><p>x<br/></p><hr /></blockquote>[size=1]").splitlines() == ["x", "1"]


def test_open_tags_take_linear_time():
    assert len(plain("<a =" + " =" * 200_000)) > 400_000 and len(plain("[b=" * 50_000)) == 150_000
