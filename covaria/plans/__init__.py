"""covaria.plans"""
