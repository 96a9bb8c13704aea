"""Names, towns and forms of numbers by locale, for surrogates: own small tables.

In a form, ``#`` is a digit and ``?`` a capital letter; ``{street}``, ``{number}`` and ``{town}`` stand for parts of an address.
Account forms follow the published lengths of each country's IBAN.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Locale:
    men: str
    women: str
    last: str
    towns: str
    streets: str
    address: str
    phones: tuple[str, ...]
    country: str
    account: str

    @property
    def first_names(self) -> list[str]:
        return self.men.split() + self.women.split()


LOCALES = {
    "it_IT": Locale(
        "Marco Luca Andrea Paolo Giorgio Matteo Davide Stefano", "Giulia Anna Sara Elena Chiara Laura Marta Silvia", "Rossini Ferrero Marchetti Galli Conte Leone Longo Martinelli Serra Vitale",
        "Milano,Roma,Torino,Bologna,Verona,Genova,Padova,Siena", "Via Garibaldi,Via Mazzini,Corso Cavour,Via Dante,Piazza Verdi,Viale Europa", "{street} {number}, ##### {town}",
        ("+39 3## #######", "+39 0## ######", "0#-########"), "IT", "?######################",
    ),
    "en_US": Locale(
        "James Robert Michael David Daniel Thomas Kevin Brian", "Mary Linda Susan Karen Lisa Nancy Emily Laura", "Smith Johnson Miller Davis Wilson Moore Taylor Harris Clark Lewis",
        "Springfield,Franklin,Clinton,Madison,Arlington,Georgetown,Salem,Bristol", "Oak Street,Maple Avenue,Main Street,Cedar Lane,Park Road,Lake Drive", "{number} {street}, {town}, ?? #####",
        ("+1 2## ### ####", "(5##) ###-####", "001-4##-###-####"), "GB", "????##############",
    ),
    "en_GB": Locale(
        "Oliver Harry George Jack Arthur Henry Edward Simon", "Amelia Olivia Grace Alice Emma Sophie Lucy Helen", "Smith Jones Brown Evans Walker Wright Hughes Green Hall Wood",
        "Leeds,Bristol,York,Oxford,Exeter,Norwich,Durham,Bath", "High Street,Church Lane,Station Road,Mill Lane,Victoria Road,Kings Road", "{number} {street}, {town}, ??# #??",
        ("+44 7### ######", "+44 20 #### ####", "0161 ### ####"), "GB", "????##############",
    ),
    "de_DE": Locale(
        "Jonas Lukas Felix Stefan Thomas Martin Peter Jan", "Anna Lena Marie Sophie Julia Katrin Petra Sabine", "Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Wolf",
        "Bremen,Dresden,Kassel,Mainz,Ulm,Trier,Jena,Halle", "Hauptstraße,Bahnhofstraße,Gartenweg,Schulstraße,Lindenallee,Am Markt", "{street} {number}, ##### {town}",
        ("+49 15# #######", "+49 30 ########", "0### ######"), "DE", "##################",
    ),
    "fr_FR": Locale(
        "Louis Hugo Jules Pierre Antoine Michel Luc Olivier", "Emma Louise Camille Claire Sophie Julie Marie Manon", "Martin Bernard Dubois Moreau Laurent Simon Michel Lefebvre Leroy Roux",
        "Lyon,Nantes,Rennes,Dijon,Angers,Nice,Lille,Tours", "Rue Victor Hugo,Rue de la Gare,Avenue Foch,Place du Marché,Rue des Lilas,Boulevard Voltaire", "{number} {street}, ##### {town}",
        ("+33 6 ## ## ## ##", "+33 1 ## ## ## ##", "04 ## ## ## ##"), "FR", "#######################",
    ),
    "es_ES": Locale(
        "Javier Carlos Miguel Pablo Diego Sergio Manuel Jorge", "Carmen Lucía Marta Elena Isabel Paula Rosa Ana", "García López Martínez Sánchez Pérez Gómez Ruiz Díaz Moreno Romero",
        "Sevilla,Zaragoza,Málaga,Burgos,León,Toledo,Cádiz,Murcia", "Calle Mayor,Calle del Sol,Avenida de la Paz,Plaza de España,Calle Real,Paseo del Río", "{street} {number}, ##### {town}",
        ("+34 6## ### ###", "+34 91# ### ###", "9## ## ## ##"), "ES", "####################",
    ),
    "pt_PT": Locale(
        "João Pedro Tiago Rui Nuno Miguel André Luís", "Ana Maria Inês Sofia Rita Joana Marta Teresa", "Silva Santos Ferreira Pereira Oliveira Costa Rodrigues Martins Sousa Gomes",
        "Porto,Braga,Coimbra,Évora,Aveiro,Faro,Leiria,Setúbal", "Rua da Igreja,Rua do Comércio,Avenida da Liberdade,Rua Direita,Largo da Feira,Rua das Flores", "{street} {number}, ####-### {town}",
        ("+351 9## ### ###", "+351 21# ### ###", "2## ### ###"), "PT", "#####################",
    ),
    "nl_NL": Locale(
        "Daan Sem Lucas Jan Pieter Bram Thijs Willem", "Emma Julia Sanne Anouk Eva Fleur Lotte Marieke", "Jansen Bakker Visser Smit Meijer Mulder Bos Vos Peters Hendriks",
        "Utrecht,Leiden,Delft,Breda,Zwolle,Arnhem,Gouda,Haarlem", "Dorpsstraat,Kerkstraat,Molenweg,Stationsweg,Schoolstraat,Julianalaan", "{street} {number}, #### ?? {town}",
        ("+31 6 ########", "+31 20 ### ####", "0## #######"), "NL", "????##########",
    ),
    "pl_PL": Locale(
        "Jakub Piotr Tomasz Marcin Adam Michał Paweł Jan", "Anna Maria Zofia Julia Ewa Katarzyna Agnieszka Magdalena", "Nowak Wójcik Kamiński Zieliński Lewandowski Dąbrowski Mazur Krawczyk Pawlak Zając",
        "Kraków,Gdańsk,Poznań,Lublin,Toruń,Opole,Radom,Gdynia", "ul. Polna,ul. Leśna,ul. Słoneczna,ul. Krótka,ul. Szkolna,ul. Ogrodowa", "{street} {number}, ##-### {town}",
        ("+48 5## ### ###", "+48 22 ### ## ##", "6## ### ###"), "PL", "########################",
    ),
    "cs_CZ": Locale(
        "Jan Petr Jiří Tomáš Martin Pavel Lukáš Ondřej", "Jana Eva Hana Lenka Petra Lucie Kateřina Alena", "Novák Svoboda Dvořák Černý Procházka Kučera Veselý Horák Němec Marek",
        "Brno,Plzeň,Olomouc,Liberec,Zlín,Jihlava,Tábor,Opava", "Nádražní,Školní,Husova,Zahradní,Komenského,Palackého", "{street} {number}, ### ## {town}",
        ("+420 6## ### ###", "+420 2## ### ###", "7## ### ###"), "CZ", "####################",
    ),
    "ro_RO": Locale(
        "Andrei Mihai Alexandru Ion Vlad Radu Cristian George", "Maria Elena Ioana Ana Andreea Cristina Mihaela Raluca", "Popescu Ionescu Popa Stan Dumitru Stoica Gheorghe Matei Marin Rusu",
        "Cluj-Napoca,Iași,Brașov,Sibiu,Oradea,Arad,Galați,Pitești", "Strada Florilor,Strada Mihai Eminescu,Bulevardul Unirii,Strada Libertății,Strada Morii,Calea Victoriei", "{street} nr. {number}, ###### {town}",
        ("+40 7## ### ###", "+40 21 ### ####", "07## ### ###"), "RO", "????################",
    ),
    "hu_HU": Locale(
        "Bence Máté László István Péter Gábor Zoltán Tamás", "Anna Eszter Katalin Éva Zsófia Judit Ágnes Réka", "Nagy Kovács Tóth Szabó Horváth Varga Kiss Molnár Németh Farkas",
        "Debrecen,Szeged,Pécs,Győr,Miskolc,Eger,Sopron,Szolnok", "Kossuth utca,Petőfi utca,Rákóczi út,Ady Endre utca,Fő utca,Béke tér", "#### {town}, {street} {number}.",
        ("+36 20 ### ####", "+36 1 ### ####", "06 30 ### ####"), "HU", "########################",
    ),
}
