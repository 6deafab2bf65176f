"""License texts that the scan knows, by SPDX-like name: notices and headers here, whole texts
(``<name>-text``) in ``license_texts/``.

Fixed values: public license wording."""

from importlib import resources

TEMPLATES: dict[str, str] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "All-rights-reserved": "All rights reserved.",
}

_GNU_HEADER = (
    "This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published "
    "by the Free Software Foundation{comma} {version} This {what} is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
_LATER = "either version {0} of the License, or (at your option) any later version."
_ONLY = "version {0} of the License."
_GPL, _AGPL, _LGPL = "General Public License", "Affero General Public License", "Lesser General Public License"
_LIBRARY = "Library General Public License"


def _gnu(what: str, name: str, version: str, later: str = _LATER) -> str:
    return _GNU_HEADER.format(what=what, stop=":" if version == "3" else ";", name=name, comma="," if version == "3" else ";",
                              version=later.format(version))


TEMPLATES |= {
    "GPL-1.0": _gnu("program", _GPL, "1"),
    "GPL-2.0": _gnu("program", _GPL, "2"),
    "GPL-2.0-only": _gnu("program", _GPL, "2", _ONLY),
    "GPL-3.0-only": _gnu("program", _GPL, "3", _ONLY),
    "AGPL-3.0": _gnu("program", _AGPL, "3"),
    "LGPL-2.0": _gnu("library", _LIBRARY, "2").partition(" This library is distributed")[0],
    "LGPL-3.0": _gnu("library", _LGPL, "3").partition(" This library is distributed")[0],
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.0-notice": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
}

#: Creative Commons: the sentence of the deed, and the short form by abbreviation.
for _kind, _words in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
                      "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
                      "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version, _area in {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}.items():
        _named = _words if _version == "4.0" else _words.replace("NoDerivatives", "NoDerivs")
        for _name, _text in ((f"CC-{_kind}-{_version}-deed",
                              f"This work is licensed under a Creative Commons {_named} {_version} {_area} License."),
                             (f"CC-{_kind}-{_version}-short", f"Licensed under CC {_kind} {_version}.")):
            if _text not in TEMPLATES.values():  # some have names above
                TEMPLATES[_name] = _text

#: Licenses as notices call them: "licensed under [the] X [version n]" in any of its forms.
for _name, _called in {
    "BSD-2-Clause": "the BSD 2-Clause License", "BSD-3-Clause": "the BSD 3-Clause License", "BSD": "the BSD License",
    "ISC": "the ISC License", "zlib": "the zlib License", "Unlicense": "the Unlicense", "BSL-1.0": "the Boost Software License, Version 1.0",
    "MPL-1.1": "the Mozilla Public License, Version 1.1", "MPL-2.0": "the Mozilla Public License, Version 2.0",
    "MPL-1.1-abbreviated": "the MPL 1.1", "MPL-2.0-abbreviated": "the MPL 2.0",
    "EPL-1.0": "the Eclipse Public License, Version 1.0", "EPL-2.0": "the Eclipse Public License, Version 2.0",
    "Artistic-1.0": "the Artistic License 1.0", "Artistic-2.0": "the Artistic License 2.0",
    "GFDL-1.2": "the GNU Free Documentation License, Version 1.2", "GFDL-1.3": "the GNU Free Documentation License, Version 1.3",
    "CC0-1.0-abbreviated": "CC0 1.0",
    "GPL-1.0": "the GNU General Public License, version 1",
}.items():
    TEMPLATES[f"{_name}-notice"] = f"Licensed under {_called}."
for _kind, _full, _versions in (("GPL", _GPL, "1 2 3"), ("AGPL", _AGPL, "3"), ("LGPL", _LGPL, "2.1 3")):
    for _version in _versions.split():
        _name = f"{_kind}-{_version if '.' in _version else _version + '.0'}"
        TEMPLATES |= {
            f"{_name}-notice-of": f"Licensed under version {_version} of the GNU {_full}.",
            f"{_name}-notice-gnu": f"Licensed under the GNU {_kind}, version {_version}.",
            f"{_name}-notice-abbreviated": f"Licensed under the {_kind}, version {_version}.",
            f"{_name}-notice-gnu-v": f"Licensed under the GNU {_kind}v{_version}.",
            f"{_name}-notice-v": f"Licensed under the {_kind}v{_version}.",
        }

#: Names without version: the license is named, which version of it is not.
TEMPLATES |= {"MIT-notice-bare": "Licensed under MIT.", "Apache-notice": "Licensed under the Apache License."}
for _kind, _full in (("GPL", _GPL), ("AGPL", _AGPL), ("LGPL", _LGPL)):
    TEMPLATES |= {f"{_kind}-notice": f"Licensed under the GNU {_full}.", f"{_kind}-notice-gnu": f"Licensed under the GNU {_kind}.",
                  f"{_kind}-notice-abbreviated": f"Licensed under the {_kind}."}

for _file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
    TEMPLATES[_file.name.removesuffix(".txt") + "-text"] = _file.read_text(encoding="utf-8")
