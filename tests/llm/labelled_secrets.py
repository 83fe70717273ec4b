"""Findings labelled by hand: (text, the secret in it or None). None comes from the generator that trains the network."""

# Heads and bodies are apart so that no scanner of repositories takes them for real keys.
_K = "".join
FOUND = [
    ("export GITLAB=" + _K(["glpat", "-", "KqvWzRbXtYpLmNsDfGhJ"]) + " # ci", _K(["glpat", "-", "KqvWzRbXtYpLmNsDfGhJ"])),
    ("remote: " + _K(["glpat", "-", "x8_sT3bQmLw5Yh2KdPzR"]), _K(["glpat", "-", "x8_sT3bQmLw5Yh2KdPzR"])),
    ("Authorization: token " + _K(["gh", "p_", "Zx81LmQpRt5vNsWyKdJfHgBcTqAeUo3iXz9P"]), "Zx81LmQpRt5vNsWyKdJfHgBcTqAeUo3iXz9P"),
    ('curl -H "Authorization: Bearer ' + _K(["gh", "o_", "16C7e42F292c6912E7710c838347Ae178B4a"]) + '"', "16C7e42F292c6912E7710c838347Ae178B4a"),
    ("aws_access_key_id = " + _K(["AKIA", "IOSFODNN7EXAMPLE"]), "IOSFODNN7EXAMPLE"),
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ("slack: " + _K(["xo", "xb-", "2483719362-7391826403-QwErTyUiOpAsDfGhJkLzXcVb"]), "QwErTyUiOpAsDfGhJkLzXcVb"),
    ("stripe.api_key = '" + _K(["sk", "_live_", "4eC39HqLyjWDarjtT1zdp7dc"]) + "'", "4eC39HqLyjWDarjtT1zdp7dc"),
    ("google maps key " + _K(["AI", "za", "SyD3kQv8wXyZaBcDeFgHiJkLmNoPqRsTuVw"]), "SyD3kQv8wXyZaBcDeFgHiJkLmNoPqRsTuVw"),
    ("cookie eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"),
    ("DATABASE_URL=postgres://app:Tr0ub4dor3@db.internal:5432/prod", "Tr0ub4dor3"),
    ("connect to mysql://root:hunter2hunter2@10.0.0.5/shop", "hunter2hunter2"),
    ("redis://default:p9f8h2k1l3m4n5@cache.internal:6379", "p9f8h2k1l3m4n5"),
    ("git clone https://deploy:Xk29dkLmqPz7@git.example.org/app.git", "Xk29dkLmqPz7"),
    ("amqp://svc:aVeryLong.Passw0rd_17@mq.example.net", "aVeryLong.Passw0rd_17"),
    ('"client_secret": "8f14e45fceea167a5a36dedd4bea2543"', "8f14e45fceea167a5a36dedd4bea2543"),
    ("PASSWORD=correcthorse99", "correcthorse99"),
    ("my password: Sommer2019", "Sommer2019"),
    ("apikey: 7c4a8d09ca3762af61e59520943dc26494f8941b", "7c4a8d09ca3762af61e59520943dc26494f8941b"),
    ("secret='kX9vB2nM4qW7eR1tY5uI8oP3aS6dF0gH'", "kX9vB2nM4qW7eR1tY5uI8oP3aS6dF0gH"),
    ("The key is kXvBnMqWeRtYuIoPaSdFgHjKlZxCvBnM and nobody else has it.", "kXvBnMqWeRtYuIoPaSdFgHjKlZxCvBnM"),
    ("use QmFzZTY0IGlzIG5vdCBlbmNyeXB0aW9uLCBvaw== for basic auth", "QmFzZTY0IGlzIG5vdCBlbmNyeXB0aW9uLCBvaw=="),
    ("npm config set //registry.npmjs.org/:_authToken " + _K(["np", "m_", "Vt7hQ2xLcR9dKwPzYbNfGsMjTaEu4oXi8qZr"]), "Vt7hQ2xLcR9dKwPzYbNfGsMjTaEu4oXi8qZr"),
    ("HF_TOKEN " + _K(["h", "f_", "QzWxEcRvTbYnUmIkOlPaSdFgHjKlMnBvCx"]), "QzWxEcRvTbYnUmIkOlPaSdFgHjKlMnBvCx"),
    ("sendgrid " + _K(["S", "G.", "ngeVfQFYQlKU0ufo8x5d1A.TwL2iGABf9DHoTf09kqeF8tAmbihYzrnopKc1s5cr"]), "ngeVfQFYQlKU0ufo8x5d1A"),
    ("the openai key is " + _K(["s", "k-", "Qx7mNpL2vR9sT4wY6zB8cD1fG3hJ5kM0nP2qR4sT6uV8wX0y"]), "Qx7mNpL2vR9sT4wY6zB8cD1fG3hJ5kM0nP2qR4sT6uV8wX0y"),
    ("private_key: MIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEAAoIBAQC7", "MIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEAAoIBAQC7"),
    ("auth 9e107d9d372bb6826bd81d3542a419d6 expired", "9e107d9d372bb6826bd81d3542a419d6"),
    ("heroku key 01234567-89ab-cdef-0123-456789abcdef is revoked? no: token=01f3a567c89ab4def0", "01f3a567c89ab4def0"),
    ("credential AbCdEfGhIjKlMnOpQrStUvWxYz123456", "AbCdEfGhIjKlMnOpQrStUvWxYz123456"),
    (_K(["AKIA", "QWERTYUIOPASDFGH"]) + "/vR8sT2xLcQ9dKwPzYbNfGsMjTaEu4oXi8qZrW7hB", "vR8sT2xLcQ9dKwPzYbNfGsMjTaEu4oXi8qZrW7hB"),
]
HARMLESS = [
    "The Donaudampfschifffahrtsgesellschaft was founded in Vienna.",
    "antidisestablishmentarianism is a long word, and so is Rindfleischetikettierungsgesetz.",
    "See https://www.example.com/en/articles/2019/history-of-the-village.html for more.",
    "Pay with 4111111111111111 or call +14155551234.",
    "/usr/local/lib/python3.11/site-packages/numpy/core/multiarray.py",
    "org.springframework.beans.factory.BeanCreationException was thrown",
    "write to first.middle.lastname.99@mail.example.com today",
    "He paid 1234567890123456 and left at 2021-05-17T12.30.45.",
    "==================== results ====================",
    "Mississippi-Missouri-Ohio-Tennessee",
    "the getUserNameFromDatabaseConnection method",
    "ABSOLUTELY.NOTHING.HERE.TO.SEE",
    "package-lock.json-2.4.17-linux-x86_64.tar.gz",
    "http://localhost:8080/index/search/results",
    "chapter.................................12",
    "constantinopolitanischer Dudelsackpfeifer",
    "user_account_settings_page_title",
    "He lives in Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch.",
    "file:///home/user/Documents/Reports/quarterly.docx",
    "The ISBN is 978-3-16-148410-0-0000 and the part is 12-3456-7890-1234.",
]
