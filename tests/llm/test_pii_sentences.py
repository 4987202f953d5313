"""Problems 3 and 8 on small texts of known result."""

import pytest
from pyspark.sql import functions as F

from dispatchline.llm import pii, sentences

CONTACTS = [("Art", "Trounbray", None), ("José", "Drake", None), ("Hope", "O'Healgar", None), ("Zofia", "Brook-Tarven", None), (None, None, None)]


def find(spark, rows, contacts=CONTACTS):
    m = spark.createDataFrame([(i, b, f) for i, (b, f) in enumerate(rows)], "row_id bigint, body string, from_name string")
    c = spark.createDataFrame(contacts, "given_name string, family_name string, account_ref string")
    return m, c, sorted((r.row_id, r.field_name, r.pii_kind, r.span_text) for r in pii.find(m, c).collect())


@pytest.mark.parametrize(
    ("body", "spans"),
    [
        ("Call me on (0114) 496 0127 or +44 7700 900099 else 0044 7700 900 508.", [("phone", "(0114) 496 0127"), ("phone", "+44 7700 900099"), ("phone", "0044 7700 900 508")]),
        ("ring 07700-900-273, 020 7946 0752, +1 (555) 555-0153, 07700900413", [("phone", "+1 (555) 555-0153"), ("phone", "020 7946 0752"), ("phone", "07700-900-273"), ("phone", "07700900413")]),
        ("mobile oh double seven oh oh nine double oh four eight three and more", [("phone", "oh double seven oh oh nine double oh four eight three")]),
        ("Serial 2207 700 900 12, part 12004567890, order 07-7700-9, reading 004 512 77, sent 12/03/2026, ref QX-12345-C, @warmhome_chat", []),
        ("write to art.trounbray@mail.test or reply at zofia dot drake at home dot invalid", [("email", "art.trounbray@mail.test"), ("email", "zofia dot drake at home dot invalid")]),
        ("x_y (at) post.example", [("email", "x_y (at) post.example")]),
        ("My ID is QQ 12 34 56 C, NI number QQ-12-34-56-A, 9083157FW and 987-65-4321", [("idnum", "9083157FW"), ("idnum", "987-65-4321"), ("idnum", "QQ 12 34 56 C"), ("idnum", "QQ-12-34-56-A")]),
        ("come to Flat 12C, 14 Skercombe Court, QZ19 1BJ round the back", [("address", "Flat 12C, 14 Skercombe Court, QZ19 1BJ")]),
        ("2-4 Nelcombe Rd has the key, moved it out of the way, meet at 10 the close end", [("address", "2-4 Nelcombe Rd")]),
        ("ul. Trandfield 190/19 oraz вул. Фласфиелд, 212 тут", [("address", "ul. Trandfield 190/19"), ("address", "вул. Фласфиелд, 212")]),
        ("Speak to Mrs Trounbray upstairs, ask for Drake, José", [("name", "Drake, José"), ("name", "Trounbray")]),
        ("my name is art\t\n trounbray", [("name", "art\t\n trounbray")]),
        ("I hope to hear, have faith; the art of the drake", []),
        ("no rush, Hope", [("name", "Hope")]),
        ("Neighbour called A. O'Healgar let them in", [("name", "A. O'Healgar")]),
        ("My ID is QQ 12 34 56 D. Trounbray, Art has the keys. Ref qx-1-c. Drake upstairs", [("idnum", "QQ 12 34 56 D"), ("name", "Drake"), ("name", "Trounbray, Art")]),
        ("104 Drake Street is the house", [("address", "104 Drake Street")]),
        ("the letter is for Mr Anderson and for Art Anderson but it went to Dr. O'Neil Brown", [("name", "Anderson"), ("name", "Art Anderson"), ("name", "O'Neil Brown")]),
        ("ask for J. Kowalski at the door", [("name", "J. Kowalski")]),
        ("ring mrs kowalski at 12 long acre lane the bell", [("address", "12 long acre lane"), ("name", "kowalski")]),
        ("Speak to Kowalski Lettings. Hi Zofia It may rain", [("name", "Zofia")]),
        ("061 234 5678 else 050 1234567", [("phone", "050 1234567"), ("phone", "061 234 5678")]),
        ("", []), ("?", []),
    ],
)
def test_bodies(spark, body, spans):
    assert [x[2:] for x in find(spark, [(body, None)])[2]] == spans


def test_senders(spark):
    rows = [(None, x) for x in ("Art Trounbray (Baslin Estates)", "Harbourgate Lettings", "Drake, José 07700900413", "Voicemail", "-", "", None, "A. Drake", "Luntor & Co", "hope", "Web enquiry")]
    assert [x[0:1] + x[2:] for x in find(spark, rows)[2]] == [(0, "name", "Art Trounbray"), (2, "name", "Drake, José"), (2, "phone", "07700900413"), (7, "name", "A. Drake"), (9, "name", "hope")]


def test_replacement_keeps_the_rest(spark):
    m, c, _ = find(spark, [("Ask for Art Trounbray, 07700900413 ​thanks", "Drake, José"), (None, None), ("", "")])
    assert [r[1:] for r in sorted(pii.redact(m, c).collect())] == [("Ask for [NAME], [PHONE] ​thanks", "[NAME]"), (None, None), ("", "")]


def test_repeats_long_texts_and_an_empty_directory(spark):
    long = "no data here, " * 20_000 + "ring 07700900413 or 07700900413"
    c = "given_name string, family_name string, account_ref string"
    m = spark.createDataFrame([(1, long, "x"), (1, long, "x")], "row_id bigint, body string, from_name string")
    got = pii.find(m, spark.createDataFrame([], c)).collect()
    assert [(r.row_id, r.span_text) for r in got] == [(1, "07700900413")] * 2
    assert pii.find(m.where("row_id > 5"), spark.createDataFrame([], c)).count() == 0


def test_long_stretches_are_taken_whole(spark):
    domain = ".".join(["mail"] * 2000) + ".test"
    local = "-".join(["art"] * 3000)
    spelled = "art" + " dot x" * 1500 + " at mail" + " dot sub" * 1500 + " dot test"
    street = "Flat 3, 14 " + "Sker" * 3000 + " Court, QZ19 1BJ"
    bodies = [f"to {local}@{domain} now", f"write {spelled}, please", f"come to {street} today"]
    m, c, got = find(spark, [(b, None) for b in bodies])
    assert [x[2:] for x in got] == [("email", f"{local}@{domain}"), ("email", spelled), ("address", street)]
    assert [r[1] for r in sorted(pii.redact(m, c).collect())] == ["to [EMAIL] now", "write [EMAIL], please", "come to [ADDRESS] today"]


def test_time_grows_with_the_text():
    import time

    given, family = {"art", "zofia"}, {"trounbray"}
    ac = pii.automaton(given, family)

    def seconds(n):
        text = "Ask for Art Trounbray, 07700900413. " * n
        began = time.process_time()
        assert len(pii.spans(text, ac, family)) == 2 * n
        return time.process_time() - began

    seconds(200)
    small, large = min(seconds(1000) for _ in range(3)), min(seconds(8000) for _ in range(3))
    assert large < 16 * small
    for hard in ("a dot " * 20_000, "oh " * 20_000, "(at) " * 20_000, "x court " * 20_000, "1" * 50_000, "mr " * 20_000):
        began = time.process_time()
        pii.spans(hard, ac, family)
        assert time.process_time() - began < 5


@pytest.mark.parametrize(
    ("text", "source", "want"),
    [
        ("We waited until 6 p.m. Why? It kept on… then stopped. No. 4 calls.", "sms_log", ["We waited until 6 p.m.", "Why?", "It kept on… then stopped.", "No.", "4 calls."]),
        ("Mr. and Mrs. Hill of No. 3b paid £8.40, i.e. too much. See a.example/x?id=4 for it.", "sms_log", ["Mr. and Mrs. Hill of No. 3b paid £8.40, i.e. too much.", "See a.example/x?id=4 for it."]),
        ('"Stop! It leaks!" the caller shouted. “Leave it,” Art said, “it is off.” No.', "sms_log", ['"Stop! It leaks!" the caller shouted.', "“Leave it,” Art said, “it is off.”", "No."]),
        ("[08:22] The tap drips\n- Yes! Fine.\n14. Who? Me", "job_sheet", ["[08:22] The tap drips", "- Yes!", "Fine.", "14. Who?", "Me"]),
        ("Dear Mrs. Hill,\n\nThe tap is\nwet. It is No.\n4 there.\n\nBye", "Email-Archive ", ["Dear Mrs. Hill,", "The tap is\nwet.", "It is No.\n4 there.", "Bye"]),
        ("we waited until 6 p.m. st. ives is far. it is 10 p.m. on sunday. \"is it off?\" she asked.", "sms_log", ["we waited until 6 p.m.", "st. ives is far.", "it is 10 p.m. on sunday.", '"is it off?" she asked.']),
        ("Bitte kommen Sie z. B. am 3. März vorbei! Er wohnt in der Kolstr. 152 im 2. Stock. „Ist es aus?“, fragte sie.", None, ["Bitte kommen Sie z. B. am 3. März vorbei!", "Er wohnt in der Kolstr. 152 im 2. Stock.", "„Ist es aus?“, fragte sie."]),
        ("「すぐ来て。」と言われました。No.3が必要です！もう一度……いや。", None, ["「すぐ来て。」と言われました。", "No.3が必要です！", "もう一度……いや。"]),
        ("“快来！漏水了！”他喊道。今天有人来吗？", None, ["“快来！漏水了！”他喊道。", "今天有人来吗？"]),
        ("हाँ। बिल नं. 28 नहीं मिला। क्या?", None, ["हाँ।", "बिल नं. 28 नहीं मिला।", "क्या?"]),
        ("น้ำรั่วค่ะ ช่างมาตอน 3.30 น. แล้วค่ะ", None, ["น้ำรั่วค่ะ", "ช่างมาตอน 3.30 น. แล้วค่ะ"]),
        ("Πού είναι το αρ. 828; Στάζει! «Έκλεισε;» ρώτησε εκείνη.", None, ["Πού είναι το αρ. 828;", "Στάζει!", "«Έκλεισε;» ρώτησε εκείνη."]),
        ("اتصل د. سامر اليوم. هل يأتي أحد؟ نعم!", None, ["اتصل د. سامر اليوم.", "هل يأتي أحد؟", "نعم!"]),
        ("«Чи закрито?» — спитала вона. Ми на вул. Банден, буд. 5. Котел і т. д. щоранку!", None, ["«Чи закрито?» — спитала вона.", "Ми на вул. Банден, буд. 5.", "Котел і т. д. щоранку!"]),
        ("« Vite ! Ça coule ! » criait M. Hill. Ça va ?", None, ["« Vite ! Ça coule ! » criait M. Hill.", "Ça va ?"]),
        ("a\ue001b\ue00f cd. Da", None, ["a\ufffdb\ufffd cd.", "Da"]),
        ("", None, []), ("  \n ", None, []), (None, None, []), ("🙏", None, ["🙏"]), ("---", None, []),
    ],
)
def test_sentences(spark, text, source, want):
    d = spark.createDataFrame([(1, text, source, "x", 1)], "doc_id bigint, text string, source string, sentence string, _no int")
    got = sorted(sentences.sentences(d).collect(), key=lambda r: r.start_char)
    assert [r.sentence for r in got] == want
    assert [r.sent_no for r in got] == list(range(1, len(want) + 1))
    if text and "\ue001" not in text:
        assert all(text[r.start_char - 1 :].startswith(r.sentence) for r in got)


def test_quotations_lines_and_blanks_of_any_length(spark):
    said = "“" + "It leaks. Who knows? " * 500 + "Come.” he said."
    greek = "Στάζει " + "και " * 300 + "τώρα; Ναι."
    letter = "Dear Art,\n" + " " * 100 + "\nThe tap\nis wet.\n" + " \n" * 200 + "Bye"
    for text, source, n in ((f"Stop. {said} No.", None, 3), (f"«{said[1:-10]}» Да.", None, 2), (greek, None, 2), (letter, "email_archive", 3)):
        d = spark.createDataFrame([(1, text, source)], "doc_id bigint, text string, source string")
        assert sentences.sentences(d).count() == n, text[:20]


def test_nothing_is_shuffled(spark):
    d = spark.range(0, 100, 1, 8).select(F.col("id").alias("doc_id"), F.lit("One. Two.").alias("text"), F.lit(None).cast("string").alias("source"))
    assert "Exchange" not in sentences.sentences(d)._jdf.queryExecution().executedPlan().toString()


def test_long_and_repeated_documents(spark):
    text = "The tap drips. Who knows? " * 4000
    d = spark.createDataFrame([(1, text, None)] * 2, "doc_id bigint, text string, source string")
    got = sentences.sentences(d, with_text=False)
    assert got.count() == 16_000
    assert got.agg(F.max("start_char")).first()[0] == len(text) - len("Who knows? ") + 1
    assert sentences.sentences(d.where("doc_id > 1")).count() == 0
