import pytest
from pyspark.sql import functions as F

from lodestack.llm import residue as R

RESIDUE = [
    "# {{ project_name }}\n\nText.", "Docs for ${PROJECT_NAME}", "Last changed on <%= date %> by us.", "Welcome to %%TITLE%%", "Maintained by [Insert name here].", "Dear %s, your index of %d files is ready.", "Hello undefined, you have NaN reviews.", "errors.page.generic_title",
    "Owner: [object Object], updated Invalid Date", "Intro\n\nTBD\n\nMore", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "Your content goes here.", "Text folgt.", "Description à compléter.", "404 - Not Found", "<h1>Bad Gateway</h1> Try again later.",
    "HTTP/1.1 503 Service Unavailable We will be back shortly.", "Seite nicht gefunden. Zurück zur Startseite.", "Accès refusé. Veuillez vous connecter.", "Página no encontrada.", "Please enable JavaScript to view this page.", "Cette page nécessite JavaScript.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    "404 - Página não encontrada", "Страница не найдена", "ページが見つかりません", "Pagina niet gevonden", "JavaScript è necessario per questa pagina.", "Kontakt: [Ihr Name hier]", "We'll be right back after some upgrades.", "Для работы сайта необходим JavaScript.", "Redirecting. Click here if you are not sent on within 5 seconds.",
    "We noticed unusual traffic from your network. Solve the puzzle to go on.", "Notes\n\nDescribe the module in one or two sentences.", "Notes\n\n- Item one\n- Item two", "429 Slow down\n\nBack to the start page", "Sie werden weitergeleitet.", "Welcome to {{ site_name }}!",
    "Verify you are human by ticking the box below.", "We use cookies. Accept all or manage your choices to read on.", "Checking your browser before you continue.", "Real text before.\n\nThis page needs scripts to work.", "﻿Please en­able JavaScript to run this app.", "Released XX.XX.XXXX", "Write to __PROJECT__.",
]
CONTENT = [
    "", "   ", "The renderer replaces `{{ title }}` with the name.", 'The crawler drops pages that only say "Please enable JavaScript"; we had 14.', "A 502 Bad Gateway in the log means the cache was cold.", "```\nHello {{ name }}\n```\nThat prints a name.", "export WORKSPACE=${WORKSPACE:-.}", 'println!("{}", {name});',
    "`undefined` and `NaN` are mapped to null before the index sees them.", "We use lorem ipsum in the layout tests so that nothing matches.", "TBD items of the last meeting are closed.", '"Access denied" is what a caller without a session reads.', "In ERB the tag `<%= value %>` prints.", "    <%= indented.code %>", "fn f() -> u8 { 404 }",
    "Set the {{ name }} field in your template to the value you want and see how each {{ field }} works.", "We rewrote the JavaScript client; it needs no build step.", "404 entries were dropped", "Redirecting to the new index takes 3 ms.", "Describe the failure and add a trace.", "Item one of the list is late.",
    "The handler answers 404 when the chunk is missing.", "See [the notes](notes.md) and [1].", "let x = config::load().not_found;", "Set `retry` if the server is slow.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert R.reasons(text), text


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert R.reasons(text) == [], text


def test_tables(spark):
    rows = [(1, "404 - Not Found", "a"), (1, "404 - Not Found", "a"), (2, None, "a"), (None, "404 - Not Found", "a"), (3, "", None), (4, "plain sentence here. " * 20_000, None), (5, ("word " * 9 + "\n") * 3000 + "Text folgt.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, reasons string")
    assert {r.doc_id for r in R.residue_documents(docs.withColumn("flagged", F.lit(1))).collect()} == {1, 5}
    assert R.residue_documents(docs.limit(0)).count() == 0
    assert {r.doc_id for r in R.without_residue(docs).collect()} == {2, None, 3, 4} and set(R.without_residue(docs).columns) == set(docs.columns)
