"""Added spans on sentences written by hand, not by the training templates (their cue words overlap in part)."""

from tramline.llm import pii


def luhn(digits):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


A, B, C, D = (luhn(x) for x in ("401288888888188", "543011110000222", "37144963539843", "34787344967112"))
POS = ["Please drop a line to jane.roe [at] harbour [dot] net before Friday.",
    "You can get hold of peter(at)lakeside(dot)org any evening.",
    "Anfragen bitte an kundendienst (at) stadtwerke (dot) de richten.",
    "reach out: m.lopez {at} correo {dot} es",
    "my old address was qwerty99 at hotbox dot com but I left",
    "Write info [at] museum.fr for tickets",
    "send the form to anna at riverbank dot org today",
    "Webmaster: root(at)hostfarm.io",
    "The box answers on 10[.]20[.]30[.]40 since Monday.",
    "blocked 203 dot 0 dot 113 dot 9 at the firewall",
    "C2 seen at 198(.)51(.)100(.)23",
    "login came from 172[dot]16[dot]4[dot]77",
f"She read out {A[:4]}.{A[4:8]}.{A[8:12]}.{A[12:]} over the line, visa she said",
    f"Charge it to mastercard {B[:4]}/{B[4:8]}/{B[8:12]}/{B[12:]} please",
    f"amex {C[:4]} {C[4:10]} {C[10:]} exp 09/27",
    f"His card, {D[:4]}-{D[4:10]}-{D[10:]}, was declined",
    f"credit card on file: {A[:4]}_{A[4:8]}_{A[8:12]}_{A[12:]}",
    "Ring me on (020) 7946 0958 after six",
    "office phone 555-867-5309, ask for Lee",
    "Tel. 030 901 820 im Rathaus",
    "Fax: (415) 555-0132",
    "mobile 0044 20 7946 0123 works abroad",
    "call our desk at 800.555.0199",
    "my cell is 212 555 0187",
    "Notruf telefon 0049 89 233 9600"]
NEG = ["We met at noon dot by dot the list was read.",
    "They stay at home dot dot dot and wait.",
    "invoice 1234.5678.9012.3456 was paid twice",
    "Release 400[.]300[.]999[.]512 is out",
    "Chapter 12.500.7001 covers taxes",
    "ISBN 978 014 3039 is out of print",
    "order 371234567890123 left the depot",
    "score was 112 305 4410 over three rounds",
    "part no 555-120-3344 fits both doors",
    "tracking id 349999999999999",
    "serial 9999_8888_7777_6666 is engraved",
    "The total of 120 300 4500 people came",
    "room 201.455.8800 on the plan",
    "look at this dot it is red",
    "between 100 200 3000 and more were seen",
    "version 1.2.3.4000 of the file",
    "ticket 4411/2233/9988/7711 is void",
    "coordinates 123 456 7890 on grid",
    "meeting at ten dot agenda follows",
    "account 1000-200-3000 closed"]


def test_added_spans_on_other_texts(spark):
    docs = spark.createDataFrame(list(enumerate(POS + NEG)), "doc_id long, text string")
    found = {r.doc_id: bool(r.spans) for r in pii.personal_data(docs).collect()}
    hits, false = sum(found[i] for i in range(len(POS))), sum(found[len(POS) + i] for i in range(len(NEG)))
    assert hits >= 0.9 * len(POS) and hits >= 0.9 * (hits + false)
