"""A seeded source of labelled mails, for training and evaluation."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXAMPLE
from ..sources.names import load_names

#: Shares of the kinds of mail.
MIX = {"formal_full": 50, "formal_minimal": 10, "informal": 14, "mobile_reply": 9, "ultraminimal": 3, "inline_reply": 6, "inline_quote": 4, "forward_only": 1, "adversarial": 3}
_COMPANIES = ("株式会社サンプル", "有限会社みどり", "東西商事株式会社", "合同会社あおぞら", "南北システム株式会社")
_GREETINGS = ("お世話になっております。", "いつもお世話になっております。", "お疲れ様です。", "突然のご連絡失礼いたします。", "ご無沙汰しております。", "先日はご連絡ありがとうございました")
_CLOSINGS = ("よろしくお願いいたします。", "何卒よろしくお願いいたします。", "以上、よろしくお願いします。", "ご確認のほどよろしくお願いいたします。", "以上です。", "お返事をお待ちしております。", "敬具")
_TOPICS = ("会議の日程", "お見積り", "契約書の内容", "来週の打ち合わせ", "新しいサービス", "請求書", "システムの障害", "採用面接", "納品の時期", "資料の修正")
_SENTENCES = (
    "{t}の件でご連絡いたします。", "{t}について確認しました。", "{t}は問題ありません。", "添付の資料をご覧ください。", "{t}については{d}までにお知らせください。", "変更点は以下の通りです。",
    "{d}の午後であれば対応可能です。", "なお、{t}は来月に延期となりました。", "詳しくは別途ご説明します。", "ご不明な点がございましたらお知らせください。", "{t}を送付しますのでご査収ください。", "社内で検討した結果、{t}を進めることになりました。",
)
_CASUAL = ("明日の件、了解です。", "{t}見ました。", "あとで電話します。", "{d}でいいですか?", "ありがとう、助かりました。", "{t}はもう送ってあります。")
_ITEMS = ("・{t}", "1. {t}", "- {t}", "日時: {d} 14:00", "場所: 本社 第一会議室")
_POSITIONS = ("営業部 課長", "開発部 エンジニア", "代表取締役", "総務部", "マネージャー")


def example(seed: int, noise: float = 0.2) -> dict:
    """One labelled mail."""
    r = random.Random(seed)
    names = load_names()
    kind = r.choices(list(MIX), list(MIX.values()))[0]
    last, first = r.choice(names["last"]), r.choice(names["first"])
    lines: list[tuple[str, str]] = []
    put = lambda label, *texts: lines.extend((t, label) for t in texts)
    fill = lambda s: s.format(t=r.choice(_TOPICS), d=f"{r.randint(1, 12)}月{r.randint(1, 28)}日")

    def prose(low: int, high: int, pool: tuple[str, ...] = _SENTENCES) -> None:
        for k in range(r.randint(low, high)):
            if k and r.random() < 0.35:
                put("OTHER", "")
            put("BODY", fill(r.choice(pool)))
            if r.random() < 0.15:
                put("BODY", *(fill(r.choice(_ITEMS)) for _ in range(r.randint(1, 4))))

    def quote(depth: int = 1) -> None:
        if r.random() < 0.7:
            put("QUOTE", r.choice((f"2024年{r.randint(1, 12)}月{r.randint(1, 28)}日 {last}{first}:", f"On 2024/0{r.randint(1, 9)}/1{r.randint(0, 9)}, {r.choice(names['romaji'])} wrote:", "-----Original Message-----")))
        put("QUOTE", *("> " * depth + fill(r.choice(_SENTENCES)) for _ in range(r.randint(1, 5))))

    def signature() -> None:
        bar = r.choice(("-", "=", "_", "━", "*", "-=")) * r.randint(5, 30)
        body = [r.choice(_COMPANIES), r.choice(_POSITIONS), f"{last} {first}" if r.random() < 0.5 else last + first, f"TEL: 03-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}", f"E-mail: user{r.randint(1, 99)}@example.co.jp", "https://www.example.co.jp/", f"〒{r.randint(100, 999)}-{r.randint(1000, 9999)} 東京都千代田区"]
        kept = [x for k, x in enumerate(body) if k == 2 or r.random() < 0.7]
        if r.random() < 0.85:
            kept = [bar, *kept, *([bar] if r.random() < 0.6 else [])]
        put("SIGNATURE", *kept)

    if kind in ("formal_full", "formal_minimal", "adversarial", "inline_quote"):
        if r.random() < 0.7:
            put("GREETING", *([r.choice(_COMPANIES)] if r.random() < 0.5 else []), f"{r.choice(names['last'])}様")
            if r.random() < 0.6:
                put("OTHER", "")
        put("GREETING", r.choice(_GREETINGS))
        if r.random() < 0.6:
            put("GREETING", f"{r.choice(_COMPANIES)}の{last}です。")
        put("OTHER", "")
    elif kind == "informal" and r.random() < 0.6:
        put("GREETING", r.choice(("お疲れ様です。", f"{r.choice(names['last'])}さん", "こんにちは。")))
    if kind == "forward_only":
        put("QUOTE", "---------- Forwarded message ---------")
        quote()
    elif kind == "inline_reply":
        for _ in range(r.randint(1, 3)):
            put("QUOTE", *("> " + fill(r.choice(_SENTENCES)) for _ in range(r.randint(1, 2))))
            prose(1, 2)
    else:
        prose(*{"formal_full": (3, 9), "informal": (1, 4), "mobile_reply": (1, 2), "ultraminimal": (1, 1)}.get(kind, (1, 4)), pool=_CASUAL if kind in ("informal", "mobile_reply", "ultraminimal") else _SENTENCES)
    if kind == "inline_quote":
        quote()
        prose(1, 3)
    if kind == "adversarial":
        put("BODY", "以下のサンプルをご確認ください。", "----------", f"{r.choice(_COMPANIES)}", "TEL: 03-0000-0000", "----------")
        prose(1, 2)
    if kind not in ("forward_only", "ultraminimal", "mobile_reply") and r.random() < 0.9:
        if r.random() < 0.5:
            put("OTHER", "")
        put("CLOSING", r.choice(_CLOSINGS))
    if kind in ("formal_full", "formal_minimal", "adversarial", "inline_reply", "inline_quote") and r.random() < 0.85:
        if r.random() < 0.7:
            put("OTHER", "")
        signature()
    if kind == "mobile_reply" or kind == "informal" and r.random() < 0.3:
        put("OTHER", "")
        if kind == "mobile_reply":
            put("SIGNATURE", *(["iPhoneから送信"] if r.random() < 0.4 else []))
        quote(r.randint(1, 2))
    if r.random() < noise:
        at = r.randrange(len(lines))
        lines.insert(at, ("", "OTHER"))
    while lines and not lines[0][0]:
        lines.pop(0)
    while lines and not lines[-1][0]:
        lines.pop()
    return {
        "email_text": "\n".join(t for t, _ in lines),
        "lines": [{"text": t, "label": y, "quote_depth": len(t) - len(t.lstrip("> ").rjust(len(t))) if t.startswith(">") else 0} for t, y in lines],
        "metadata": {"template_type": kind, "has_signature": any(y == "SIGNATURE" for _, y in lines), "has_inline_quote": kind in ("inline_quote", "inline_reply"), "is_adversarial": kind == "adversarial"},
    }


def examples(spark: SparkSession, n: int, seed: int = 999, noise: float = 0.2) -> DataFrame:
    """``n`` labelled mails, made where they are needed: ``mail_id``, ``email_text``, ``lines`` and ``metadata``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(example(seed * 1_000_003 + i, noise), ensure_ascii=False) for i in ids], pa.string())], names=["mail_id", "value"])

    rows = spark.range(n).mapInArrow(run, "mail_id long, value string")
    return rows.select("mail_id", F.from_json("value", EXAMPLE).alias("e")).select("mail_id", "e.email_text", "e.lines", "e.metadata")
