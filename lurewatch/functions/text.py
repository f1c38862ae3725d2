"""Page-text Column functions (E1-E3, E9, E10, E14) and the page regexes.

Regex dialect notes (Java vs the rule semantics):
* case-insensitive matching must be Unicode-aware, hence ``(?iu)``;
* ``\\s`` is spelled out as the Unicode whitespace class;
* ``.`` must stop at ``\\n`` only, hence ``(?d)`` where ``.`` is used;
* a word boundary before a word character is written as a look-behind on the
  Unicode word class ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions.hosts import WS_CLASS

# the ASCII ranges are part of the Unicode classes; named first, they are decided without a look-up
WORD_CLASS = "[a-z0-9_\\p{L}\\p{N}]"
TOKEN_RE = WORD_CLASS + "+"

# ---------------------------------------------------------------------------
# Page signatures of the rules (patterns must stay equivalent).
# ---------------------------------------------------------------------------
PASSWORD_RE = "(?iu)type=[\"']?password[\"']?"
OTP_RE = f"(?iu)(2fa|otp|one[-{WS_CLASS}]?time)"
CARD_RE = "(?iu)(card number|ccnum|cvv|cvc)"
EXFIL_MAIL_RE = "(?iu)(mailto:|sendmail\\.php|wp-mail|phpmail|smtp)"
EXFIL_TELEGRAM_RE = "(?iu)(t\\.me/|telegram\\.(me|org)|bot_token|api\\.telegram\\.org)"
EXFIL_DISCORD_RE = "(?iu)(discord\\.gg|discord\\.com/api/webhooks)"
# The three exfiltration signatures are only ever OR-ed: one alternation, one pass over the body.
EXFIL_ANY_RE = "(?iu)(" + "|".join(r[len("(?iu)("):-1] for r in (EXFIL_MAIL_RE, EXFIL_TELEGRAM_RE, EXFIL_DISCORD_RE)) + ")"
# The same signatures as literals of folded text (``folded``): what ``(?iu)`` finds, without a pattern
PASSWORD_LITERALS = ("type=password", 'type="password', "type='password")
CARD_LITERALS = ("card number", "ccnum", "cvv", "cvc")
EXFIL_LITERALS = ("mailto:", "sendmail.php", "wp-mail", "phpmail", "smtp", "t.me/", "telegram.me", "telegram.org",
                  "bot_token", "discord.gg", "discord.com/api/webhooks")
ONE_TIME_RE = f"one[-{WS_CLASS}]?time"
JS_OBFUSCATION_RE = f"(?<!{WORD_CLASS})(atob|eval|Function\\()|fromCharCode\\("
WALLET_RE = "(window\\.ethereum|eth_requestAccounts|web3|eth_sign|walletconnect)"
WALLET_LITERALS = ("window.ethereum", "eth_requestAccounts", "web3", "eth_sign", "walletconnect")
CLIPBOARD_WRITE_LITERALS = ("replace", "execCommand", "writeText")
CLIPBOARD_WRITE_RE = "(replace|execCommand|writeText)"
KIT_COMMENT_RE = "(?iud)(phishing kit|by .* phisher|tg://|t\\.me/)"
# Same test split in two: the literal alternatives, and the backtracking ``by .* phisher``
# branch run only on texts that contain `` phisher`` at all (it cannot match otherwise).
KIT_LITERALS = ("phishing kit", "tg://", "t.me/")
KIT_PHISHER_RE = "(?iud)by .* phisher"
FORM_ACTION_RE = f"(?iu)<form[^>]*action=[\"']?([^\"'>{WS_CLASS}]+)"
TITLE_RE = "(?iusd)<title[^>]*>(.*?)</title>"
BASE64_RUN_RE = "[A-Za-z0-9+/=]{40,}"
# Runs of more than 64 characters; the look-behind tries a run at its first character alone.
# Written out, the characters are one look-up in a table of bits; ranges are tried one after the other.
BASE64_CLASS = f"[{string.ascii_letters}{string.digits}+/=]"
BASE64_LONG_RUN_RE = f"(?<!{BASE64_CLASS}){BASE64_CLASS}{{65,}}"
BASE64_STRICT_RE = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def folded(c: Column) -> Column:
    """Text in which a lower-case ASCII literal occurs where ``(?iu)`` would find it.

    Beside its two cases only these characters stand for an ASCII letter: dotted
    and dotless i, the long s and the Kelvin sign (``lower`` makes it a k).
    """
    return folded_of_lowered(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))))


def folded_of_lowered(lowered: Column) -> Column:
    """``folded`` of text that is lower-cased already (where a dotted I has become i and a combining dot)."""
    return F.replace(F.replace(lowered, F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def holds_any(c: Column, literals: Iterable[str]) -> Column:
    """True when one of the literals occurs in ``c``: byte searches, many times faster over a page body than an alternation."""
    return reduce(or_, [c.contains(x) for x in literals if x], F.lit(False))


def otp_hint(text: Column) -> Column:
    """``OTP_RE`` on folded text; its pattern runs only where both its halves occur."""
    return holds_any(text, ("2fa", "otp")) | (text.contains("one") & text.contains("time") & text.rlike(ONE_TIME_RE))


def js_obfuscation(html: Column) -> Column:
    """``JS_OBFUSCATION_RE``; the look-behind runs only on texts that hold one of its words."""
    return html.contains("fromCharCode(") | (holds_any(html, ("atob", "eval", "Function(")) & html.rlike(JS_OBFUSCATION_RE))


def tokens(c: Column) -> Column:
    """All ``\\w+`` tokens of the lower-cased text (Unicode letters, digits, underscore)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_RE), 0)


def tokens_of_lowered(lowered: Column) -> Column:
    """``tokens`` of text that is already lower-cased (saves a second ``lower`` pass)."""
    return F.regexp_extract_all(lowered, F.lit(TOKEN_RE), 0)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def looks_base64(c: Column) -> Column:
    """Length is a multiple of 4 and the text is strict, correctly padded base64."""
    return F.coalesce(c.rlike(BASE64_STRICT_RE), F.lit(False))


def content_diff_ratio_sets(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """1 - Jaccard of the token sets ``ta``/``tb`` of texts ``a``/``b``."""
    a_empty = F.coalesce(a, F.lit("")) == ""
    b_empty = F.coalesce(b, F.lit("")) == ""
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    return (F.when(a_empty & b_empty, F.lit(0.0))
            .when(a_empty | b_empty, F.lit(1.0))
            .when((F.size(ta) == 0) & (F.size(tb) == 0), F.lit(0.0))
            .otherwise(F.lit(1.0) - inter / union))


def content_diff_ratio(a: Column, b: Column) -> Column:
    return content_diff_ratio_sets(a, b, token_set(a), token_set(b))


def form_actions(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(FORM_ACTION_RE), 1)


def title_match(html: Column) -> Column:
    """True when a ``<title>`` element is present (an empty title still counts)."""
    return F.coalesce(html, F.lit("")).rlike(TITLE_RE)


def title(html: Column) -> Column:
    return F.regexp_extract(F.coalesce(html, F.lit("")), TITLE_RE, 1)


def has_high_entropy_run(html: Column) -> Column:
    """A run of >= 40 base64 characters that is longer than 64 and strict base64."""
    runs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(BASE64_LONG_RUN_RE), 0)
    return F.exists(runs, looks_base64)


def kit_comment(lowered: Column) -> Column:
    """H02 kit signature on lower-cased text (equivalent to ``KIT_COMMENT_RE``)."""
    text = folded_of_lowered(lowered)
    return holds_any(text, KIT_LITERALS) | (text.contains(" phisher") & lowered.rlike(KIT_PHISHER_RE))


def py_fixed(x: Column, digits: int) -> Column:
    """Python's ``f"{x:.Nf}"`` for values in [0, 1000): ``format_number`` rounds the exact binary
    value half-to-even like Python (``format_string`` rounds the shortest decimal half-up)."""
    return F.format_number(x, digits)


def py_repr(c: Column) -> Column:
    """Python ``repr`` of a string for evidence text: quote choice, backslash, quote and tab/newline/CR escapes."""
    dq = c.contains("'") & ~c.contains('"')
    e = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        e = F.replace(e, F.lit(raw), F.lit(esc))
    single = F.concat(F.lit("'"), F.replace(e, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(dq, F.concat(F.lit('"'), e, F.lit('"'))).otherwise(single)


def py_bool(c: Column) -> Column:
    """Render a boolean the way Python prints it (True/False) for evidence text."""
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))
