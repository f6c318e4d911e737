"""A small table of spellings whose owners are known: what the name operator is held against."""

#: (owner, name, address): invented people, organisations and accounts.
SPELLINGS = [
    ("p1", "Thomas Lindqvör", "thomas.lindqvoer@firm.example"), ("p1", "LINDQVÖR, T.", "tlindqvoer@firm.example"), ("p1", "Tom Lindqvor", "lindqvoer77@post.test"), ("p1", "lindqvoert", "thomas_lindqvoer@post.test"),
    ("p1", "Thomas A. Lindqvör (mobile)", None), ("p1", "Lindqvör, Thomas", "root@localhost.test"), ("p1", "Thoams Lindqvör", "991+tlindqvoer@users.noreply.test"), ("p1", "Thmas Lindqvö", None),
    ("p2", "Ursula Lindqvör", "ursula.lindqvoer@firm.example"), ("p2", "U. Lindqvör", "ulindqvoer@firm.example"),
    ("p3", "Theodore Lindqvör", "theodore.lindqvoer@else.example"), ("p3", "T. Lindqvör", "theodore.lindqvoer@else.example"),
    ("p4", "Jens Peter Brackwedde", "peter.brackwedde@dorf.example"), ("p4", "Brackwedde Peter", None), ("p4", "peter.brackwedde", "peter.brackwedde@dorf.example"),
    ("p5", "Walter Hesperin", "root@localhost.test"), ("p6", "Maria Ostrander", "office@firm.test"), ("p7", "Carla Ostrander", "office@firm.test"),
    ("o1", "Kolbinar Systems", "build@kolbinar.test"), ("o1", "The Kolbinar Systems Team", "kolbinar@users.noreply.test"), ("o1", "kolbinar-systems", None), ("o1", "Systems Kolbinar", None), ("o1", "Kolbniar Sys. Ltd.", "build@mail.kolbinar.test"),
    ("o2", "Kolbinar Foundation", "info@kolbinar.test"),
    ("b1", "loompost[bot]", "loompost@bots.test"), ("b1", "Loompost Bot", None), ("b1", "loompost (automation)", "1+loompost@users.noreply.test"),
]
