"""Licence notices and paragraphs by family, and paragraphs that are none: what the classifier learns from."""

from __future__ import annotations

#: Wordings of public licences and of usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see the GNU licenses page.",
        "Distributed under the terms of the GNU GPL v2 license.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License CC BY.",
        "Text is available under the Creative Commons Attribution ShareAlike License CC BY-SA 4.0.",
        "Licensed under CC BY-SA 3.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "Content is available for non commercial use under the Creative Commons license CC BY-NC-SA.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "public-domain": (
        "This work is released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Licensed under CC0 1.0 Universal public domain dedication.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one with the Mozilla Public License.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Copyright (c) 2019 the authors. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This document is proprietary and confidential. Unauthorized copying is strictly prohibited. All rights reserved.",
    ),
}

#: Paragraphs with the same words that grant nothing.
NONE = (
    "He lost his driving licence after the accident and had to take the bus to work.",
    "The licence plate of the car was reported to the police on the following day.",
    "She studied copyright law at the university and wrote about the history of publishing.",
    "The general public was invited to the opening of the new library in version of the old hall.",
    "The apache helicopter landed near the village while the people watched from the hills.",
    "A fishing license is required in most states and it can be bought online or in a store.",
    "The warranty on the washing machine ended two years before it broke down.",
    "Students at MIT presented their robots and the jury gave the first prize to a small team.",
    "The poet took some artistic license with the facts and nobody in the audience complained.",
    "The creative industries and the commons of the village were discussed at the meeting.",
    "Rights of way are reserved for walkers and the gate must be closed at night.",
    "The domain of the function is public knowledge, said the teacher, and all of you have read it.",
    "The restaurant applied for a liquor license and the council granted it without conditions.",
    "A copyright dispute between two bands was settled out of court last week.",
    "The software engineer explained the source of the error and the merge was without restriction.",
    "The bank reserved all tables for the evening and the guests were free of charge.",
    "the of and in to that was for with is are by at on from this it be have the of and in to",
)
