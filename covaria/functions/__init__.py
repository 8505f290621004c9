"""covaria.functions"""
