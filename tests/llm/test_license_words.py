"""License spans are aligned with their template: words that change what it says, and those that don't."""

from __future__ import annotations

from framewell.llm import licenses as L

GNU = "This is free software: you can redistribute it and/or modify it under the terms of the {} Public License as published by the Free Software Foundation, either version 3"
MIT = "Permission is hereby {}, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"


def labels(spark, texts: list) -> list:  # noqa: ANN001
    out = {r.doc_id: ",".join(sorted({s.label for s in r.spans or []})) for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [out[i] for i in range(len(texts))]


def test_other_words_in_place_of_telling_ones(spark) -> None:
    texts = [GNU.format(x) for x in ("GNU General", "Eclipse", "Eclipse General", "GNU Generl", "Mozzarella Cheese")] + [MIT.format(x) for x in ("granted", "denied", "grantd", "refused")]
    assert labels(spark, texts) == ["gpl", "", "", "gpl", "", "mit", "", "mit", ""]


def test_whole_texts_with_other_words_around_and_within(spark) -> None:
    whole = {label: text for label, text in L.TEMPLATES if len(text.split()) > 60}
    assert set(whole) == {"mit", "isc", "bsd", "zlib"}
    texts = [f"Copyright 2020 Somebody. {text.capitalize()}. More words follow." for text in whole.values()]
    texts += [" ".join(w for i, w in enumerate(text.split()) if i % 40 != 7) for text in whole.values()]
    assert labels(spark, texts) == [*whole, *whole]
    assert labels(spark, [whole["mit"].replace("without warranty", "with guarantee"), whole["zlib"].replace("must not be misrepresented", "shall always be praised")]) == ["mit", ""]


def test_telling_words() -> None:
    told = set(L.telling())
    assert {"gnu", "general", "granted", "mit", "apache", "mozilla", "unencumbered"} <= told and not {"the", "software", "license", "of"} & told
