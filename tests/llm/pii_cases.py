"""Sentences written by hand, with what in them is personal: names of rare and common surnames and characters, foreign names,
numbers and addresses that no training text has. In each pair: the text, its spans as (type, words)."""

CASES = [
    ("昨天下午王建国在股东大会上回答了提问。", [("NAME", "王建国")]),
    ("据悉，张伟和李明已于上月离职，接任者是邹文静。", [("NAME", "张伟"), ("NAME", "李明"), ("NAME", "邹文静")]),
    ("公司邀请秦岚、诸葛明与皇甫志国参加路演。", [("NAME", "秦岚"), ("NAME", "诸葛明"), ("NAME", "皇甫志国")]),
    ("负责人孔志强补充说，项目将于年底完工。", [("NAME", "孔志强")]),
    ("慕容雪女士自2015年起任职于本公司。", [("NAME", "慕容雪")]),
    ("原告赵志国，住杭州市西湖区文三路398号，身份证号码330106197805124417。", [("NAME", "赵志国"), ("ADDRESS", "杭州市西湖区文三路398号"), ("ID_NUMBER", "330106197805124417")]),
    ("有意者请致电13588012345，或写信至hr.team@greenfield.org。", [("PHONE", "13588012345"), ("EMAIL", "hr.team@greenfield.org")]),
    ("龚自珍的诗集再版，编者为裴松。", [("NAME", "龚自珍"), ("NAME", "裴松")]),
    ("联系人欧阳建国 座机 0571-87654321", [("NAME", "欧阳建国"), ("PHONE", "0571-87654321")]),
    ("监事会主席由霍启刚担任，缪建民列席。", [("NAME", "霍启刚"), ("NAME", "缪建民")]),
    ("护照E30918274的持有人樊振东已签收。", [("ID_NUMBER", "E30918274"), ("NAME", "樊振东")]),
    ("公司聘任约翰·史密斯为首席技术官。", [("NAME", "约翰·史密斯")]),
    ("快递请寄南京市鼓楼区中山北路200号3幢501室，收件人褚时健。", [("ADDRESS", "南京市鼓楼区中山北路200号3幢501室"), ("NAME", "褚时健")]),
    ("問詢人：龐麗娟，手機 139 2233 4455", [("NAME", "龐麗娟"), ("PHONE", "139 2233 4455")]),
    ("研究员阎肃、阮小二共同署名。", [("NAME", "阎肃"), ("NAME", "阮小二")]),
    ("The project is led by John Smith from the Boston office.", [("NAME", "John Smith")]),
    ("Michael Johnson, our new treasurer, joined in May.", [("NAME", "Michael Johnson")]),
    ("For details write to anna.kowalska@northbank.example or phone +44 20 7123 4567.", [("EMAIL", "anna.kowalska@northbank.example"), ("PHONE", "+44 20 7123 4567")]),
    ("Minutes taken by Elizabeth Warren and approved by Tom Baker.", [("NAME", "Elizabeth Warren"), ("NAME", "Tom Baker")]),
    ("Zhuge Ming resigned as director on 3 May 2021.", [("NAME", "Zhuge Ming")]),
    ("The shares were bought by Qin Lan and Zou Wenjing.", [("NAME", "Qin Lan"), ("NAME", "Zou Wenjing")]),
    ("Parcels go to 27 Maple Avenue; ask for Peter Novak.", [("ADDRESS", "27 Maple Avenue"), ("NAME", "Peter Novak")]),
    ("Auditor Jessica Alvarez signed the opinion.", [("NAME", "Jessica Alvarez")]),
    ("本公司2021年营业收入为12,345.67万元，同比增长8.9%。", []),
    ("张家港保税区的仓库租金上调，成都与武汉的门店照常营业。", []),
    ("高管薪酬方案经董事会审议通过，余额转入下一年度。", []),
    ("石油、黄金和白银价格走高，江苏与安徽的需求平稳。", []),
    ("客服热线400-820-8820，合同编号HT-2021-000123。", []),
    ("Net profit for the First Quarter rose, said the Annual Report.", []),
    ("Order No. 20210513-0007 was shipped from Hong Kong to New York.", []),
    ("统一社会信用代码91330100MA27XY3K5B的企业已完成变更登记。", []),
    ("投资者王某某在互动平台提问，董秘已回复。", []),
]
