"""Verbatim licence headers, wrapped as files hold them."""
import textwrap

from tremor.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
WANT = [(MIT, "mit-text"), (BSD, "bsd3-text"), (APACHE, "apache2-header"), (GPL, "gpl2-header"), (GPL.replace("software;", "software:").replace("version 2", "version 3"), "gpl3-header"),
        (MPL, "mpl2-header"), ("SPDX-License-Identifier: MIT", "mit-tag"), ("SPDX-License-Identifier: Apache-2.0", "apache2-tag"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd3-tag"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl3-tag")]


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n") for line in (textwrap.wrap(part, width, break_on_hyphens=False) or [""]))


def test_wrapped_headers(spark):
    forms = [lambda t: t, lambda t: wrapped(t, 72), lambda t: wrapped(t, 60, "# "), lambda t: "Some file.\r\n" + wrapped(t, 78, " * ").replace("\n", "\r\n") + "\r\n */"]
    docs = [(100 * k + j, form(text)) for k, (text, _) in enumerate(WANT) for j, form in enumerate(forms)]
    got = sorted((r["doc_id"], r["rule"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), joined=True).collect())
    assert got == [(100 * k + j, rule) for k, (_, rule) in enumerate(WANT) for j in range(len(forms))]


def test_sentences_still_begin_and_end_with_pieces(spark, edge, empty):
    docs = spark.createDataFrame([(1, "Not licensed under the MIT License."), (2, "Licensed under the MIT License\nand other words"), (3, "all rights\nreserved"),
                                  (4, "Licensed under the MIT License agreement."), (5, "SPDX-License-Identifier: MIT OR Apache-2.0"), (6, "a|Released under the MIT License.|")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["rule"]) for r in licenses.scan(docs, joined=True).collect()) == [(2, "mit-use"), (3, "no-licence")]
    assert licenses.scan(edge, joined=True).collect() == [] and licenses.scan(empty, joined=True).collect() == []


def test_no_match_of_single_pieces_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, after = ({(r["doc_id"], r["license"]) for r in licenses.scan(docs, joined=j).collect()} for j in (False, True))
    assert before and before <= after
