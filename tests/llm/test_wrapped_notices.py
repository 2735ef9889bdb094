"""Licence notices that are wrapped over adjacent lines."""

import pytest

from tessera.llm import license_scans

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
MIT = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated documentation"
NC = "This work is licensed under a Creative Commons Attribution\nNonCommercial 4.0 International License"
CASES = {
    BSD: "bsd",
    BSD.replace("source", "source\n").replace("\n", "\n# "): "bsd",
    f"Copyright 2020 A. Person. All rights reserved.\n{BSD}\nand some other words follow on this line": "bsd,reserved",
    MIT: "mit",
    NC: "cc-by-nc",
    "it under the terms of the GNU\nGeneral Public License as published\nby the Free Software Foundation": "gpl",
    f"{BSD}\n{MIT}": "bsd,mit",
    BSD.replace("\n", "\n\n"): "",
    "the river has a wide\nsource and the people use it\nin winter with or without a boat": "",
    "Released under the MIT License": "mit",
}


@pytest.mark.parametrize("before", ["", "some prose of a few words stands here\n"])
def test_wrapped_notices_are_put_together(spark, before):
    docs = spark.createDataFrame([(i, before + text) for i, text in enumerate(CASES)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in license_scans.license_scan(docs).collect()}
    assert {text: found[i].licenses for i, text in enumerate(CASES)} == CASES
    first = 1 if before else 0
    assert found[0].n_confirmed == 1 and found[0].n_unconfirmed == 0 and found[0].found.startswith(f"{first}:bsd:")
