"""Small tables that the policies run with; fixed values, validated before use."""

from __future__ import annotations

from functools import lru_cache

from lectern.operators.policies.audited import Resources
from lectern.operators.policies.comment import Emotes
from lectern.operators.policies.context import Contexts
from lectern.operators.policies.reading import Entry, Lexicon

LEXICON = Lexicon(
    (
        Entry("up", "word"),
        Entry("YYDS", "initialism"),
        Entry("JDK", "version_stem", spelled=True),
        Entry("Tomcat", "version_stem"),
        *(Entry(x, "initialism") for x in ("API", "HTML", "CSS", "HTTP", "HTTPS", "URL", "URI", "DNS", "CPU", "GPU", "SDK")),
        Entry("Python", "version_stem"),
        Entry("Java", "version_stem"),
        Entry("Docker", "word"),
        Entry("iPhone", "version_stem"),
        Entry("RTX", "version_stem", spelled=True),
        Entry("MySQL", "compound", parts=(("My", False), ("SQL", True))),
        Entry("OpenGL", "compound", parts=(("Open", False), ("GL", True))),
        Entry("JSON", "ambiguous"),
        Entry("SQL", "ambiguous"),
        Entry("AI", "initialism"),
        Entry("LLM", "initialism"),
        Entry("ChatGPT", "compound", parts=(("Chat", False), ("GPT", True))),
    )
)

CONTEXTS = Contexts(
    slang=(("u1s1", False, "有一说一"),),
    codes={"985": "九八五", "211": "二幺幺"},
    education=("大学", "高校", "院校", "学校", "学历", "本科", "硕士", "博士", "毕业", "考研", "高考", "招生", "名校", "学位", "双一流"),
    projects=("工程",),
)

#: A few names and pictures of our own choice, enough to run every rule.
EMOTES = Emotes(platform=frozenset({"微笑", "doge", "大哭"}), pictures=frozenset({"😊", "😂", "👍", "👍🏽"}))
NAMES = {"🔨": "锤子", "🍎": "苹果", "🐶": "狗", "🚗": "汽车", "⚽": "足球"}


@lru_cache(maxsize=1)
def resources() -> Resources:
    """All tables, or an error that lists what is wrong with them."""
    found = Resources(EMOTES, NAMES, LEXICON, CONTEXTS)
    if bad := found.problems():
        raise ValueError(f"invalid policy tables: {bad}")
    return found
