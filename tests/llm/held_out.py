"""Texts written by hand for measuring problem 2: by the author of the training templates, but with none of their phrases and no sentence of a table."""

TEXTS = [
    ("Morning all, Aleksandr Volkov is out sick, so Priya Raman covers the rota.", [("person", "Aleksandr Volkov"), ("person", "Priya Raman")]),
    ("My mum Dorothy Hargreaves moved in with us.", [("person", "Dorothy Hargreaves")]),
    ("The bug was first seen by Tomasz Wiśniewski on the night shift.", [("person", "Tomasz Wiśniewski")]),
    ("Shout-out to Mbali Dlamini and J. Okonkwo for the rescue!", [("person", "Mbali Dlamini"), ("person", "J. Okonkwo")]),
    ("def test_user():\n    u = User(first='Ada', full='Ada Brockhurst', mail='ada.brock@quietmail.net')", [("person", "Ada Brockhurst"), ("email", "ada.brock@quietmail.net")]),
    ("Ring the plumber, Dave Pickersgill, 0161 496 0123, before noon", [("person", "Dave Pickersgill"), ("phone", "0161 496 0123")]),
    ("Office switchboard is 0207 946 0958 and the night desk 0207 946 0321.", [("phone", "0207 946 0958"), ("phone", "0207 946 0321")]),
    ("wrong number? it says +353 1 555 0188 here", [("phone", "+353 1 555 0188")]),
    ("(212) 555-0144 keeps hanging up", [("phone", "(212) 555-0144")]),
    ("Whatsapp me on +55 11 95555-0123", [("phone", "+55 11 95555-0123")]),
    ("mobile = '+61 491 570 156'", [("phone", "+61 491 570 156")]),
    ("Sie erreichen mich mobil: 0171 3920456", [("phone", "0171 3920456")]),
    ("Mon portable, c'est le 06 39 98 12 34", [("phone", "06 39 98 12 34")]),
    ("微信同号 138 0013 8000", [("phone", "138 0013 8000")]),
    ("Unsubscribe m.keller@postfach-nord.de please", [("email", "m.keller@postfach-nord.de")]),
    ("my address there is oliver dot twist at workhouse dot org", [("email", "oliver dot twist at workhouse dot org")]),
    ("ping sanna.lind(at)havsbris(dot)se", [("email", "sanna.lind(at)havsbris(dot)se")]),
    ("WARN bounce hard to=<zoe+news@tinyletters.co>", [("email", "zoe+news@tinyletters.co")]),
    ("GET /unsubscribe?u=carol.m@fastbox.io 302", [("email", "carol.m@fastbox.io")]),
    ("escribe a lucia_romero@correo-sur.es si falla", [("email", "lucia_romero@correo-sur.es")]),
    ("His social is 219-09-9999, don't paste it again", [("idnum", "219-09-9999")]),
    ("NI number QQ 12 34 56 C on the payslip", [("idnum", "QQ 12 34 56 C")]),
    ("mi NIE es Y1234567X y caduca pronto", [("idnum", "Y1234567X")]),
    ("CPF do cliente: 123.456.789-09", [("idnum", "123.456.789-09")]),
    ("Aadhaar 2345 6789 0123 was scanned twice", [("idnum", "2345 6789 0123")]),
    ("passport K04567891 expires in June", [("idnum", "K04567891")]),
    ("他的身份证是11010519491231002X，别外传", [("idnum", "11010519491231002X")]),
    ("Steuer-Identifikationsnummer 86 095 742 719 fehlt im Antrag", [("idnum", "86 095 742 719")]),
    ("PESEL 44051401359 passes the check digit", [("idnum", "44051401359")]),
    ("PAN card AFZPK7190K attached", [("idnum", "AFZPK7190K")]),
    ("Post the keys to 17 Larch Grove, Leeds LS6 3DP today", [("address", "17 Larch Grove, Leeds LS6 3DP")]),
    ("Crew meets at 4021 Juniper Trail, Boise, ID 83702 at nine", [("address", "4021 Juniper Trail, Boise, ID 83702")]),
    ("Treffpunkt: Lindenstraße 14, 20099 Hamburg", [("address", "Lindenstraße 14, 20099 Hamburg")]),
    ("El taller está en Calle Olmo 7, 2º, 28012 Madrid", [("address", "Calle Olmo 7, 2º, 28012 Madrid")]),
    ("On se retrouve au 8 rue des Lilas, 69003 Lyon", [("address", "8 rue des Lilas, 69003 Lyon")]),
    ("快递送到杭州市西湖区文三路259号3幢502室", [("address", "杭州市西湖区文三路259号3幢502室")]),
    ("Spedire a Via Garibaldi 22, 20121 Milano", [("address", "Via Garibaldi 22, 20121 Milano")]),
    ("room change for Dr. Helene Vogt, ward 6", [("person", "Helene Vogt")]),
    ("Frau Sabine Krautwurst ruft zurück", [("person", "Sabine Krautwurst")]),
    ("señor Ignacio Belmonte firmó ayer", [("person", "Ignacio Belmonte")]),
    ("Merci à Océane Lachance pour la relecture", [("person", "Océane Lachance")]),
    ("王建国昨天请假了", [("person", "王建国")]),
    ("报告由陈思远撰写", [("person", "陈思远")]),
    ("同事李娜说已经修好了", [("person", "李娜")]),
    ("patient_name,ward\n\"Quigley, Maeve\",B2", [("person", "Quigley, Maeve")]),
    ("{\"passenger\": \"Hamza Siddiqui\", \"seat\": \"14C\"}", [("person", "Hamza Siddiqui")]),
    ("copyright (c) 2019 Wolfgang Brandstätter", [("person", "Wolfgang Brandstätter")]),
    ("interviewed Chiamaka Eze-Obi for the SRE role", [("person", "Chiamaka Eze-Obi")]),
    ("landlord: Mr. Peter van der Meer", [("person", "Peter van der Meer")]),
    ("KEVIN O'SULLIVAN signed the lease", [("person", "KEVIN O'SULLIVAN")]),
    ("Apache Kafka and Delta Lake run on Azure Databricks", []),
    ("We compared Google Chrome with Mozilla Firefox on Windows Server", []),
    ("Black Friday traffic hit the Load Balancer in Frankfurt", []),
    ("The Data Protection Officer role is vacant", []),
    ("Error Code 4711 in Module Loader at Line 12", []),
    ("uploaded 1234567890 bytes in 17.25 s, job 20250314-0091", []),
    ("pip install requests==2.31.0; see https://pypi.example/simple", []),
    ("2024-11-05 08:15:30.123 worker-7 restarted, heap 512 1024 2048", []),
    ("docker login -u ci registry@sha256:0f1e2d3c", []),
    ("svn co svn://build@vcs.example/trunk", []),
    ("选择 文件 菜单，再点 保存 按钮", []),
    ("服务器返回五百错误，已经回滚", []),
    ("Der Neue Index wird beim Nächsten Start gebaut", []),
    ("iban check skipped for row 00012345678", []),
    ("SELECT 10.0.0.1, 255.255.255.0, 443 FROM hosts", []),
    ("icon@2x.png not found, using icon.png", []),
    ("Spring Boot and Ruby on Rails", []),
    ("May Day release, August Update, Will Fix", []),
]
