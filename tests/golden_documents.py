"""Small positioned documents of known structure, set from a list of lines by a page writer."""

from __future__ import annotations

from dataclasses import dataclass, field

BODY, LEFT, RIGHT = 10.0, 60.0, 340.0
FACES = {"plain": "Times-Roman", "strong": "Times-Bold", "typewriter": "CourierNew"}


@dataclass
class Page:
    """Writes lines from the top down; every call returns the page, so pages read as one expression."""

    y: float = 735.0
    rows: list[tuple] = field(default_factory=list)

    def put(self, text, x=LEFT, size=BODY, face="plain", y=None):
        self.rows.append((text, float(x), float(self.y if y is None else y), float(size), face))
        return self

    def title(self, text, size):
        self.y -= 12
        self.put(text, size=size, face="strong")
        self.y -= 2 * size
        return self

    def text(self, *lines, step=1.4, x=LEFT, face="plain"):
        for one in lines:
            self.put(one, x=x, face=face)
            self.y -= step * BODY
        return self

    def gap(self, points=16.0):
        self.y -= points
        return self

    def margin(self, head, foot=None, number=None):
        self.put(head, size=8, y=770)
        if foot:
            self.put(foot, size=8, y=45)
        return self.put(str(number), x=290, size=8, y=28) if number is not None else self


BEES = ["Une colonie d'abeilles vit", "toute l'année dans la ruche", "autour d'une seule reine,", "qui pond presque sans arrêt.",
        "Les ouvrières les plus âgées", "quittent le nid au matin", "et rapportent du nectar ou", "de l'eau selon les besoins."]
MILL = ["Le moulin du village tourne", "encore trois jours par mois", "pour moudre le blé récolté", "sur les collines voisines.",
        "Sa roue, refaite en chêne,", "reçoit l'eau d'un petit bief", "dont le débit règle seul", "la vitesse de la meule."]


def side_by_side(page):
    top = page.y
    for i, (left, right) in enumerate(zip(BEES, MILL)):
        page.put(left, LEFT, y=top - 15 * i).put(right, RIGHT, y=top - 15 * i)
    return page


def guide(number):
    return (Page().margin("Guide du verger - Atelier municipal", "Document libre de droits, Atelier municipal", number)
            .title(f"{number}. Saison {number}", 15)
            .text(f"Les travaux de la saison {number} commencent tôt.", "On observe les arbres avant de tailler."))


def prices():
    page = Page().title("Marché couvert", 15).text("Les tarifs affichés valent pour la semaine.").gap()
    for i, pair in enumerate([("Produit", "Unité"), ("Poires Williams", "Cageot de bois"), ("Noix sèches", "Sac de toile")]):
        for x, cell in zip((LEFT, 240), pair):
            page.put(cell, x, face="plain" if i else "strong", y=page.y - 18 * i)
    return page


DOCUMENTS = {
    "one_title": [Page().title("Récolte du miel", 17).text(
        "Le miel se récolte à la fin de l'été.", "On retire les cadres un par un.", "Chaque cadre est ensuite centrifugé.")],
    "two_numbers": [Page().title("1. Choisir la terre", 15).text("Une terre légère se réchauffe plus vite.").gap()
                    .title("2. Semer les graines", 15).text("On sème à la main quand le gel est passé.")],
    "deep_numbers": [Page().title("1. Outils", 17).text("Un bon outil dure toute une vie.").gap()
                     .title("1.1 Outils à main", 13.5).text("On les range au sec après usage.").gap()
                     .title("1.1.1 Sécateurs", 11.5).text("La lame se nettoie avec un chiffon.").gap()
                     .title("1.2 Machines", 13.5).text("Elles demandent plus d'entretien.").gap()
                     .title("2. Arrosage", 17).text("On arrose le soir pour perdre moins d'eau.")],
    "only_text": [Page().text("Les brebis montent à l'alpage au mois de juin.", "Le berger les compte à chaque passage de col.",
                              "Elles redescendent avant la première neige.")],
    "margins": [guide(n) for n in (1, 2, 3)],
    "steps": [Page().title("Pain au levain", 15).text("Il faut réunir peu de choses :", "- Farine", "- Sel", "- Levain")
              .text("Le travail suit toujours le même ordre :", "1. Pétrir la pâte", "2. Attendre une nuit", "3. Cuire à four chaud")],
    "price_table": [prices()],
    "one_formula": [Page().title("Pression", 15).text("La force que subit une paroi dépend de", "la surface sur laquelle elle s'exerce et on",
                                                     "écrit cette relation ainsi :").gap(24)
                    .put("P = F/S²", x=240, size=11).gap(36).text("Une lame fine coupe donc mieux qu'une", "lame épaisse, à force égale, puisque",
                                                                "la surface de contact est réduite.").gap(24)
                    .text("La perte mesurée = 3 % sur cet essai.")],
    "program": [Page().title("Relevé des ruches", 15).text("On ouvre d'abord le carnet de mesures :")
                .text("import csv, statistics", "rows = list(csv.reader(open('ruches.csv')))", face="typewriter")
                .text("Le carnet est alors prêt.")],
    "columns": [side_by_side(Page(y=690))],
    "columns_below_title": [side_by_side(Page().title("Vivre de la campagne toute l'année", 16).gap())],
    "same_titles": [Page().margin("Cahier de l'apprenti - Menuiserie").title(f"Exercice {n}", 15)
                    .text(f"Tracer puis scier la pièce numéro {n} sans aide.") for n in (1, 2, 3)],
    "broken_words": [Page().title("Vocabulaire", 15).text("L'agri-", "culture de montagne reste rare.",
                                                         "Le garde-manger reste frais en été.")],
    "two_pages": [
        Page().margin("Carnet - Potager", number=1).title("1. Printemps", 17)
        .text("Le sol se prépare dès que la gelée s'éloigne.", "On retourne seulement la couche du dessus.").gap()
        .title("1.1 Semis", 13.5).text("À la fin du mois, on aura :", "- Semé les fèves", "- Repiqué les choux"),
        Page().margin("Carnet - Potager", number=2).title("2. Été", 17).text("L'eau devient le premier souci du jardinier.").gap()
        .title("2.1 Paillage", 13.5).text("Une couche de paille garde la fraîcheur.").text("from garden import mulch", face="typewriter")],
    "pieces_of_a_line": [Page(y=690).put("Le mot ").put("rouet", x=104, face="strong").put(" désigne un outil.", x=140).gap(18)
                         .text("Phrase suivante, séparée.")],
}

PAGE_SCHEMA = "doc_id string, page_no int, width double, height double"
FRAGMENT_SCHEMA = ("doc_id string, page_no int, seq int, text string, x double, y double, font_size double, "
                   "font_name string, bold boolean, italic boolean, mono boolean")
CALL_SCHEMA = ("doc_id string, page_no int, seq int, kind string, text string, tm array<double>, cm array<double>, "
               "operands array<double>, font_name string, font_size double")


def _each():
    for name, pages in DOCUMENTS.items():
        for number, page in enumerate(pages):
            yield name, number, page.rows


def page_rows():
    return [(name, number, 612.0, 792.0) for name, number, _ in _each()]


def fragment_rows():
    return [(name, number, seq, text, x, y, size, FACES[face], face == "strong", False, face == "typewriter")
            for name, number, rows in _each() for seq, (text, x, y, size, face) in enumerate(rows)]


def page_text_rows():
    return [(name, number, "".join(f"{row[0]}\n" for row in sorted(rows, key=lambda r: -r[2]))) for name, number, rows in _each()]
